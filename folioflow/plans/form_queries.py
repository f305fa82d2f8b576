"""Queries over smaller expressions: forms, projections, sets of values, steps of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import fields, taxid
from ..functions import text as T
from ..operators import batches as B
from ..operators import pages as P
from ..operators import process, vendors
from ..sources import files
from .registry import register
from .standins import DOCUMENTS, batches, documents, table

_D = "WITH " + DOCUMENTS


@register("flt02_agg03_complete_documents", f"{_D} SELECT id FROM d WHERE rfc IS NOT NULL AND fecha_documento IS NOT NULL AND tipo_documento IS NOT NULL AND nombre_proveedor IS NOT NULL")
def complete_documents(spark, sf_dir):
    return documents(spark, sf_dir).na.drop(subset=list(B.FIELDS)).select("id")


@register("flt03_supported_types", "SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 2)")
def supported_types(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("pdf", "exe", "msg", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").where(kind.isin(*V.SUPPORTED_TYPES)).select("p_partkey")


@register("flt04_batch_keys", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def batch_keys(spark, sf_dir):
    key = F.concat(F.lit("BATCH-20240101-"), F.lpad("c_custkey", 6, "0"), F.when(F.col("c_custkey") % 2 == 0, "-abc123").otherwise("-ABC123"))
    return table(spark, sf_dir, "customer").where(key.rlike(V.BATCH_KEY_PATTERN)).select("c_custkey")


@register("agg04_agg14_outcome_shares", f"{_D} SELECT batch_id, count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'failed') AS failed, round_even(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*) * 100, 2) AS failed_pct FROM d GROUP BY batch_id")
def outcome_shares(spark, sf_dir):
    counts = B.status_counts(documents(spark, sf_dir))
    return counts.select("batch_id", "processed", "failed", B.percentage(F.col("failed"), F.col("processed") + F.col("failed") + F.col("pending") + F.col("other")).alias("failed_pct"))


@register("prj13_document_table", f"{_D} SELECT id, filename, source_type, route, status, rfc, fecha_documento, tipo_documento, nombre_proveedor, quality_score, quality_traffic_light FROM d")
def document_table(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "filename", "source_type", "route", "status", *B.FIELDS, "quality_score", "quality_traffic_light")


@register("prj14_set06_upload_summary", "SELECT p_partkey, 'accepted' AS kind, NULL AS reason FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'rejected', 'unsupported extension' FROM part WHERE p_partkey % 2 = 1")
def upload_summary(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".pdf").otherwise(".exe"))
    judged = B.upload_reasons(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.lit(1).alias("size")))
    accepted = judged.where("accepted").select("p_partkey", F.lit("accepted").alias("kind"))
    return accepted.unionByName(judged.where("reason IS NOT NULL").select("p_partkey", F.lit("rejected").alias("kind"), "reason"), allowMissingColumns=True)


@register("set05_distinct_in_order", "SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY c_mktsegment")
def distinct_in_order(spark, sf_dir):
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", mixed.alias("s"), "c_mktsegment")
    return rows.groupBy(F.lower("s").alias("k")).agg(F.min_by("c_mktsegment", "c_custkey").alias("c_mktsegment"), F.min("c_custkey").alias("first")).drop("k")


@register("txt01_txt05_clean_text", "SELECT n_nationkey, lower(n_name) || ' razon n' AS t FROM nation")
def clean_text(spark, sf_dir):
    raw = F.concat(F.lit("\t "), F.lower("n_name"), F.lit("\n\n raz"), F.lit(V.MOJIBAKE[0][0]), F.lit("n  ñ "))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.spaced(T.fold_spanish(T.repair_mojibake(raw))).alias("t"))


@register("txt03_txt04_folds", "SELECT n_nationkey, lower(n_name) || ' c e o a z' AS a, replace(lower(n_name), '_', ' ') || ' c e' AS b FROM nation")
def folds(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.lower(T.fold_latin(F.concat("n_name", F.lit(" Ç ê Ő ạ Ž")))).alias("a"), T.evaluation_form(F.concat("n_name", F.lit(" -- Ç. È!"))).alias("b"))


@register("txt07_ocr_digits", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t FROM orders")
def ocr_digits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.ocr_digits(F.translate(F.col("o_orderkey").cast("string"), "015", "OlS")).alias("t"))


@register("txt17_rendered_tables", "SELECT n_nationkey, '[TABLE]' || chr(10) || n_name || ' |  | 1' || chr(10) || 'x | y | ' AS t FROM nation")
def rendered_tables(spark, sf_dir):
    cells = F.array(F.array(F.col("n_name"), F.lit(None), F.lit("1")), F.array(F.lit(" "), F.lit(""), F.lit(None)), F.array(F.lit("x"), F.lit(" y "), F.lit("")))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.rendered_table(cells).alias("t"))


@register("txt19_date_anchors", "SELECT n_nationkey, n_nationkey % 4 < 2 AS anchor FROM nation")
def date_anchors(spark, sf_dir):
    token = F.element_at(F.array(*(F.lit(t) for t in ("FÉCHA:", "fecna.", "FEC", "otra"))), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", T.is_date_anchor(token).alias("anchor"))


@register("txt20_txt21_path_segments", "SELECT p_partkey, 'c|b a|' || p_partkey || ' x' AS segments FROM part")
def path_segments(spark, sf_dir):
    path = F.concat(F.lit("/b_a (2)/ c.d /"), F.col("p_partkey").cast("string"), F.lit("-x.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(vendors.path_segments(path), vendors.clean_segment), "|").alias("segments"))


@register("txt22_supplier_segments", "SELECT n_nationkey, ['f','f','t','t','f'][n_nationkey % 5 + 1] = 't' AS ok FROM nation")
def supplier_segments(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(x) for x in ("CONTRATOS", "2024", "GRUPO NORTE", "LACTEOS SA DE CV", "UNO"))), F.col("n_nationkey") % 5 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", vendors.may_be_supplier(name).alias("ok"))


@register("txt27_progress", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 0.0 ELSE least(CAST(o_orderkey % 9 AS DOUBLE) / (o_custkey % 7), 1.0) END AS share FROM orders")
def progress(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.progress(F.col("o_orderkey") % 9, F.col("o_custkey") % 7).alias("share"))


@register("txt29_evaluation_match", "SELECT n_nationkey, n_nationkey % 3 <> 2 AS ok FROM nation")
def evaluation_match(spark, sf_dir):
    from ..operators import evaluate

    k = F.col("n_nationkey") % 3
    got = F.when(k == 0, F.concat(F.lit("EL "), F.upper("n_name"), F.lit(", S.A."))).when(k == 1, F.lower("n_name")).otherwise("")
    return table(spark, sf_dir, "nation").select("n_nationkey", evaluate.matches("nombre_proveedor", F.col("n_name"), got).alias("ok"))


@register("snk11_mime_types", "SELECT p_partkey, ['application/pdf', 'image/png', 'application/octet-stream'][p_partkey % 3 + 1] AS mime FROM part")
def mime_types(spark, sf_dir):
    name = F.concat("p_name", F.element_at(F.array(F.lit(".PDF"), F.lit(".png"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", T.mime_type(name).alias("mime"))


@register("src02_path_list", "SELECT r_regionkey AS path FROM (SELECT 'C:\\a b.pdf' AS r_regionkey UNION ALL SELECT 'd/e.png')")
def path_list(spark, sf_dir):
    return files.path_list(spark, ' "C:\\a b.pdf" \n\n\'d/e.png\'\r\nc:\\A B.PDF\n')


@register("src09_find_by_name", "SELECT 'F' || doc_id || '.pdf' AS filename, CASE WHEN doc_id % 2 = 0 THEN '/a/f' || doc_id || '.pdf' END AS source_path FROM documents")
def find_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    there = F.when(F.col("doc_id") % 2 == 0, F.lower(name)).otherwise(F.concat(F.lit("other-"), F.lower(name)))
    index = d.select(there.alias("match_name"), F.explode(F.array(F.concat(F.lit("/b/"), F.lower(name)), F.concat(F.lit("/a/"), F.lower(name)))).alias("source_path"))
    return files.find_by_name(index, d.select(name.alias("filename")))


@register("rfc11_labelled_fallback", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BAAV782202' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS rfc FROM supplier")
def labelled_fallback(spark, sf_dir):
    # the sixth to eighth digits make no day of the twenty-second month
    number = F.concat(F.lit("BAAV782202"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "NOMBRE DEL PROVEEDOR: Juan Perez").otherwise("texto"), F.lit("\nRFC: "), number, F.lit("\nfin"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fields.tax_id(text).alias("rfc"))


@register("rfc13_ocr_hints", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ABCD850101' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS rfc FROM supplier")
def ocr_hints(spark, sf_dir):
    tail = F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")
    line = F.concat(F.when(F.col("s_suppkey") % 2 == 1, "RFC ").otherwise(""), F.lit("abcd 8SO1O1-"), tail)
    return table(spark, sf_dir, "supplier").select("s_suppkey", taxid.hint_in(line).alias("rfc"))


@register("dt09_dt10_date_context", "SELECT n_nationkey, ['2024-03-01', '2022-05-05', NULL, '2023-01-02'][n_nationkey % 4 + 1] AS fecha FROM nation")
def date_context(spark, sf_dir):
    gap = " " + "z " * 170
    texts = (
        "Fecha de emision 01/03/2024" + gap + "10/10/2023",
        "10/10/2021" + gap + "los testigos firman el presente contrato 05/05/2022",
        "en el diario oficial del 01/03/2024",
        "fecha 01/02/1999" + gap + "02-01-2023",
    )
    text = F.element_at(F.array(*(F.lit(t) for t in texts)), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", fields.document_date(text).alias("fecha"))


@register("dt06_dt12_years_and_hints", "SELECT n_nationkey, ['2022-02-28', NULL, NULL, '2029-12-31', '2024-01-01'][n_nationkey % 5 + 1] AS fecha FROM nation")
def years_and_hints(spark, sf_dir):
    texts = ("28 de febrero de 20/22", "28 de febrero de 21/01", "x", "31 de diciembre de 29", "31/12/2020")
    k = F.col("n_nationkey") % 5
    text = F.element_at(F.array(*(F.lit(t) for t in texts)), k + 1)
    docs = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("raw_text"), F.lit(None).cast("string").alias("rfc_hint"), F.when(k == 4, "2024-01-01").when(k == 0, "").alias("fecha_hint"))
    return process.parsed(docs).select("n_nationkey", F.col("fecha_documento").alias("fecha"))


@register("nam01_nam02_company_names", "SELECT n_nationkey, ['Grupo Uno SA de CV', 'Felipe Garcia', 'Panaderia y Leche'][n_nationkey % 3 + 1] AS nombre FROM nation")
def company_names(spark, sf_dir):
    raw = ("y  *Grupo Uno SA de CV, con domicilio", "Feli pe Garcia CURP 123", "  acuerdo con Panaderia y Leche a quien se dira | ")
    text = F.element_at(F.array(*(F.lit(t) for t in raw)), F.col("n_nationkey") % 3 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", fields.company_name(text).alias("nombre"))


@register("nam07_similarity_bounds", "SELECT n_nationkey, n_nationkey % 3 = 0 AS same, n_nationkey % 3 <> 2 AS near FROM nation")
def similarity_bounds(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    name = F.concat(F.lit("GRUPO NORTE "), "n_name")
    other = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit("X"))).otherwise("QQ ZZ")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fields.similarity(name, other).alias("s"))
    return rows.select("n_nationkey", (F.abs(F.col("s") - 1) < 1e-9).alias("same"), (F.col("s") > V.SHORT_NAME_MIN).alias("near"))


def _texts(spark, sf_dir):
    """Suppliers' documents: whole ones, ones with gaps that the dimension fills, ones that only a path explains, empty ones."""
    k = F.col("s_suppkey")
    tax = F.concat(F.lit("ABC850101"), F.lpad((k % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("Grupo "), F.translate(F.lpad(k.cast("string"), 5, "0"), "0123456789", "QWERTYUIOP"), F.lit(" SA DE CV"))
    head = F.lit("contrato comida rapida\nFecha de entrega: 05/05/2020\n")
    text = F.when(k % 4 == 0, F.concat(head, F.lit("PROVEEDOR: "), name, F.lit("\nRFC: "), tax)).when(k % 4 == 1, F.concat(head, F.lit("PROVEEDOR: "), name)).when(k % 4 == 2, head).otherwise("")
    path = F.concat(F.lit("/data/incoming/"), name, F.lit("/scan.pdf"))
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "supplier").select(k.alias("id"), text.alias("raw_text"), none.alias("rfc_hint"), none.alias("fecha_hint"), path.alias("file_path"))
    master = table(spark, sf_dir, "supplier").select(k.alias("ordinal"), name.alias("proveedor"), tax.alias("rfc"))
    return docs, vendors.prepared(master, "ordinal")


@register(
    "sta02_process_documents",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN s_suppkey % 4 < 3 THEN 'ABC850101' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS rfc,
    CASE WHEN s_suppkey % 4 < 3 THEN '2020-05-05' END AS fecha_documento, CASE WHEN s_suppkey % 4 < 3 THEN 'Comida Rapida' END AS tipo_documento, CASE WHEN s_suppkey % 4 < 3 THEN 100 END AS quality_score FROM supplier""",
)
def process_documents(spark, sf_dir):
    docs, master = _texts(spark, sf_dir)
    return process.processed(docs, master, 2024).select("id", "status", "rfc", "fecha_documento", "tipo_documento", "quality_score")


@register(
    "sta04_retry_without_scores",
    f"{_D} SELECT id, CASE WHEN status = 'failed' THEN 'processed' ELSE status END AS status, quality_score FROM d",
)
def retry_without_scores(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("field_confidence_json", F.lit(None).cast("string"))
    again = docs.where("status = 'failed'").select("id", F.lit("processed").alias("status"), F.lit(None).cast("string").alias("error_category"), *(F.lit("x").alias(f) for f in B.FIELDS))
    return B.apply_results(docs, again, 2024, score=False).select("id", "status", "quality_score")


@register(
    "src17_workbook_text",
    "SELECT n_nationkey AS file_id, 'Hoja: Uno' || chr(10) || 'Razon Social: Grupo ' || n_name || chr(10) || 'Razón Social | Grupo ' || n_name || chr(10) || '1 | 2' || chr(10) || 'Hoja: Dos' || chr(10) || 'fin' AS text FROM nation",
)
def workbook_text(spark, sf_dir):
    cell = lambda s, o, r, c, v: F.struct(F.lit(s).alias("sheet"), F.lit(o).alias("sheet_ord"), F.lit(r).alias("r"), F.lit(c).alias("c"), v.alias("value"))
    cells = F.array(
        cell("Uno", 0, 0, 0, F.lit("Razón Social")), cell("Uno", 0, 0, 1, F.concat(F.lit("Grupo "), "n_name")), cell("Uno", 0, 1, 0, F.lit("1")), cell("Uno", 0, 1, 1, F.lit("2")), cell("Uno", 0, 1, 2, F.lit(" ")),
        cell("Dos", 1, 4, 4, F.lit("fin")),
    )
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.explode(cells).alias("x")).select("file_id", "x.*")
    return P.workbook_text(rows)


@register("agg07_fresh_batches", "SELECT count(*) AS n FROM customer WHERE c_custkey % 5 = 4")
def partial_batches(spark, sf_dir):
    own = batches(spark, sf_dir)
    rows, _ = B.list_batches(own, documents(spark, sf_dir), limit=None, status="partial", allow_partial=True)
    return rows.agg(F.count("*").alias("n"))
