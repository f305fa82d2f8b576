"""Queries over pages, OCR tokens, spreadsheet cells and ordered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from .registry import register
from .standins import table


@register("agg20_conversation_text", "SELECT conv_id AS file_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def conversation_text(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page_index"), F.col("text").alias("page_text"))
    return P.page_text(pages).select("file_id", F.md5("text").alias("text"))


@register(
    "agg19_sta01_page_routes",
    r"""WITH f AS (SELECT conv_id AS file_id, CASE conv_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PDF' WHEN 2 THEN 'png' ELSE 'docx' END AS kind, count(*) AS n FROM conversations GROUP BY conv_id),
    s AS (SELECT file_id, unnest(CASE WHEN n <= 5 THEN range(0, n) ELSE list_sort(list_distinct([0, n - 1, n // 4, n * 2 // 4, n * 3 // 4])) END) AS i FROM f WHERE lower(kind) = 'pdf'),
    p AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS i, text FROM conversations),
    q AS (SELECT s.file_id, coalesce(p.text, '') AS t FROM s LEFT JOIN p ON p.conv_id = s.file_id AND p.i = s.i),
    a AS (SELECT file_id, avg(CASE WHEN length(t) >= 150 AND length(regexp_replace(t, '[^\pL]', '', 'g')) / greatest(1, length(replace(replace(replace(t, ' ', ''), chr(9), ''), chr(10), ''))) >= 0.5
             AND len(regexp_extract_all(t, '[A-Za-zÀ-ɏ]{3,}')) >= 10 THEN 1 ELSE 0 END) AS share, sum(length(t)) + greatest(count(*) FILTER (WHERE t <> '') - 1, 0) AS chars FROM q GROUP BY file_id)
    SELECT f.file_id, lower(kind) AS source_type, CASE WHEN lower(kind) = 'pdf' THEN CASE WHEN share >= 0.6 AND chars >= 300 THEN 'digital_pdf' ELSE 'ocr_image' END WHEN kind = 'png' THEN 'ocr_image' ELSE 'structured_document' END AS route
    FROM f LEFT JOIN a ON a.file_id = f.file_id""",
)
def page_routes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n_pages"))
    k = F.col("conv_id") % 4
    kind = F.when(k == 0, "a.pdf").when(k == 1, "b.PDF").when(k == 2, "c.png").otherwise("d.docx")
    files = first.select(F.col("conv_id").alias("file_id"), kind.alias("file_path"), "n_pages")
    pages = c.join(first, "conv_id").select(F.col("conv_id").alias("file_id"), (F.col("turn") - F.col("first")).cast("int").alias("page_index"), F.col("text").alias("page_text"))
    return P.page_routes(files, pages)


_TOKENS = "t AS (SELECT l_orderkey AS file_id, 1 AS page, l_linenumber AS ord, 'w' || l_partkey AS text, CAST(l_quantity AS INTEGER) AS left_, CAST(l_suppkey % 20 AS INTEGER) AS top, 10 AS width, CAST(8 + l_partkey % 5 AS INTEGER) AS height FROM lineitem)"


@register(
    "jn17_srt06_tokens_right_of_anchor",
    f"""WITH {_TOKENS}, j AS (SELECT a.file_id, a.ord AS anchor, t.left_, t.ord, t.text, row_number() OVER (PARTITION BY a.file_id, a.ord ORDER BY t.left_, t.ord, t.text) AS k FROM t a JOIN t ON t.file_id = a.file_id
      WHERE a.ord = 1 AND t.left_ > a.left_ + a.width AND CAST(greatest(0, least(a.top + a.height, t.top + t.height) - greatest(a.top, t.top)) AS DOUBLE) / greatest(1, least(a.height, t.height)) >= 0.45)
    SELECT file_id, anchor, string_agg(text, ' ' ORDER BY left_, ord, text) AS line FROM j WHERE k <= 6 GROUP BY file_id, anchor""",
)
def tokens_right_of_anchor(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_quantity").cast("int").alias("left"), (F.col("l_suppkey") % 20).cast("int").alias("top"), F.lit(10).alias("width"), (8 + F.col("l_partkey") % 5).cast("int").alias("height"),
    )
    return P.right_of_anchor(t, t.where("ord = 1"), 0.45, 6).select("file_id", "anchor", "line")


@register(
    "jn18_sheet_hints",
    "SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 0 THEN 'Razon Social: ' || c_name WHEN 1 THEN 'RFC: ' || c_name ELSE 'Proveedor: Grupo ' || c_name END AS hint FROM customer WHERE c_custkey % 5 <> 0",
)
def sheet_hints(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, "Razón  Social").when(k % 3 == 1, "r.f.c.").otherwise("NOMBRE DEL PROVEEDOR:")
    value = F.when(k % 5 == 0, "12 345").when(k % 3 == 2, F.concat(F.lit("Grupo "), "c_name")).otherwise(F.col("c_name"))
    cell = lambda r, c, v: F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), v.alias("value"))
    at = F.array(cell(0, 0, F.lit("Fecha")), cell(1, 1, label), cell(1, 2, F.when(k % 2 == 0, value).otherwise(F.lit("VIA"))), cell(2, 1, F.when(k % 2 == 1, value).otherwise(F.lit("99"))), cell(9, 9, F.lit("lejos de todo")))
    cells = table(spark, sf_dir, "customer").select(k.alias("file_id"), F.lit("Hoja1").alias("sheet"), F.explode(at).alias("x")).select("file_id", "sheet", "x.*")
    return P.sheet_hints(cells).select("file_id", "hint")


@register("txt16_rendered_rows", "SELECT n_nationkey, n_name || ' | a b | ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def rendered_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.rendered_row(F.array(F.lit(None).cast("string"), F.col("n_name"), F.lit(" a \n b "), F.lit(""), F.col("n_regionkey").cast("string"))).alias("line"))


@register(
    "win09_best_rotation",
    "SELECT n_nationkey AS file_id, CASE n_nationkey % 4 WHEN 0 THEN 180 WHEN 1 THEN 90 WHEN 2 THEN 270 ELSE 0 END AS angle FROM nation",
)
def best_rotation(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    best = F.when(k == 0, 180).when(k == 1, 90).when(k == 2, 270)
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.lit(1).alias("page"), F.explode(F.array(*(F.lit(a) for a in (0, 180, 90, 270)))).alias("angle"), best.alias("best"))
    text = F.when(F.col("angle") == F.col("best"), "convenio con el proveedor").otherwise("%%%")
    return P.best_rotation(pages.select("file_id", "page", "angle", text.alias("text"))).select("file_id", "angle")
