"""Queries over fields of documents: parsers on texts made from known values, scores, forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import doctype, fields, quality, taxid
from ..functions import text as T
from ..operators import evaluate as E
from .registry import register
from .standins import table

_ALPHABET = V.TAX_ALPHABET
_TYPES = "[" + ", ".join(f"'{name}'" for name, *_ in V.DOCUMENT_TYPES) + "]"
_PHRASES = [" ".join([*(some[:1]), *every]) for _, some, every, _ in V.DOCUMENT_TYPES]


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 12 YEARS"))
    k = F.col("o_orderkey")
    body = F.concat(F.lit("ABC"), F.date_format("o_orderdate", "yyMMdd"), F.lpad((k % 1000).cast("string"), 3, "0"))
    return o.select(k.alias("id"), body.alias("tax"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("slashed"), "o_orderdate")


_ORDERS = "o AS (SELECT o_orderkey AS id, 'ABC' || strftime(o_orderdate + INTERVAL 12 YEAR, '%y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS tax, strftime(o_orderdate + INTERVAL 12 YEAR, '%Y-%m-%d') AS day FROM orders)"


# tax identifiers


@register("rfc10_extract_tax_id", f"WITH {_ORDERS} SELECT id, CASE id % 6 WHEN 4 THEN NULL ELSE tax END AS rfc FROM o")
def extract_tax_id(spark, sf_dir):
    o, k = _orders(spark, sf_dir), F.col("id") % 6
    spaced = F.concat_ws(" ", F.col("tax").substr(1, 3), F.col("tax").substr(4, 2), F.col("tax").substr(6, 2), F.col("tax").substr(8, 2), F.col("tax").substr(10, 3))
    text = (
        F.when(k == 0, F.concat(F.lit("EL PROVEEDOR\nRFC: "), "tax"))
        .when(k == 1, F.concat(F.lit("EL CLIENTE con RFC CCO8605231N4\n\nproveedor "), "tax"))
        .when(k == 2, F.concat(F.lit("RFC: "), spaced))
        .when(k == 3, F.concat(F.lit("texto XYZ990101AB1\n" + "x " * 60 + "\nPROVEEDOR RFC "), "tax"))
        .when(k == 4, F.lit("CURP: GARC850101HDFRRL09\nsin datos"))
        .otherwise(F.concat(F.lit("r.f.c. "), F.lower("tax"), F.lit(" fin")))
    )
    return o.select("id", fields.tax_id(text).alias("rfc"))


@register("rfc12_foreign_tax_id", "SELECT s_suppkey, lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS rfc FROM supplier")
def foreign_tax_id(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Supplier\nUS FEDERAL TAX ID: "), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" - "), F.lpad(k.cast("string"), 7, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fields.tax_id(text).alias("rfc"))


@register("rfc01_ocr_normal_form", f"WITH {_ORDERS} SELECT id, tax AS rfc FROM o")
def ocr_normal_form(spark, sf_dir):
    o = _orders(spark, sf_dir)
    noisy = F.concat(F.lower(F.col("tax").substr(1, 3)), F.lit("-"), F.translate(F.col("tax").substr(4, 6), "0158", "OISB"), F.lit(" "), F.col("tax").substr(10, 3))
    return o.select("id", taxid.ocr_normal(noisy).alias("rfc"))


@register("rfc02_rfc03_canonical", f"WITH {_ORDERS} SELECT id, CASE id % 3 WHEN 0 THEN tax WHEN 1 THEN '12-' || lpad(CAST(id AS VARCHAR), 7, '0') END AS rfc FROM o")
def canonical(spark, sf_dir):
    k = F.col("id") % 3
    raw = F.when(k == 0, F.concat(F.lower("tax"), F.lit(" -ñ."))).when(k == 1, F.concat(F.lit("12 "), F.lpad(F.col("id").cast("string"), 7, "0"))).otherwise(F.lit(" -"))
    return _orders(spark, sf_dir).select("id", taxid.canonical(raw).alias("rfc"))


@register(
    "rfc04_rfc05_valid_date",
    "SELECT o_orderkey AS id, try_strptime('20' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0'), '%Y%m%d') IS NOT NULL AS ok FROM orders",
)
def valid_date(spark, sf_dir):
    k = F.col("o_orderkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    return table(spark, sf_dir, "orders").select(k.alias("id"), taxid.acceptable(F.concat(F.lit("ABC"), two(30), two(14), two(33), F.lit("XY1"))).alias("ok"))


_CHECK = f"""(11 - list_sum(list_transform(range(1, 12), lambda i: (instr('{_ALPHABET}', substr(tax, i, 1)) - 1) * (13 - i))) % 11)"""


@register("rfc06_check_digit", f"WITH {_ORDERS} SELECT id, substr(tax, 12, 1) = CASE {_CHECK} WHEN 11 THEN '0' WHEN 10 THEN 'A' ELSE CAST(CAST({_CHECK} AS INTEGER) AS VARCHAR) END AS ok FROM o")
def check_digit(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", taxid.check_digit_is_right(F.col("tax")).alias("ok"))


@register("rfc07_best_candidate", f"WITH {_ORDERS} SELECT id, CASE id % 3 WHEN 0 THEN 'VESF940524LT8' WHEN 1 THEN tax ELSE 'NADA' END AS rfc FROM o")
def best_candidate(spark, sf_dir):
    k = F.col("id") % 3
    # a digit that never checks out keeps the second case to the date alone
    offers = F.when(k == 0, F.array(F.lit("nada"), F.col("tax"), F.lit("VESF-940524-LT8"))).when(k == 1, F.array(F.lit(""), F.lit("zzz"), F.col("tax"))).otherwise(F.array(F.lit("nada"), F.lit("x")))
    o = _orders(spark, sf_dir)
    return o.where(~(taxid.check_digit_is_right(F.col("tax")) & (k == 0))).unionByName(o.where(taxid.check_digit_is_right(F.col("tax")) & (k == 0)).withColumn("tax", F.lit("nada"))).select("id", taxid.best_of(offers).alias("rfc"))


@register("rfc08_rfc09_person_repair", "SELECT c_custkey, 'VESF' AS prefix, CASE WHEN c_custkey % 2 = 0 THEN 'VESF940524LT8' END AS rfc FROM customer")
def person_repair(spark, sf_dir):
    name, raw = F.lit("José Felipe Velázquez Solís"), F.when(F.col("c_custkey") % 2 == 0, "RFC VESE 9405249TB").otherwise("sin fecha")
    rows = table(spark, sf_dir, "customer").select("c_custkey", taxid.person_prefix(name).alias("prefix"))
    # one repair for each distinct input, as texts repeat
    repairs = table(spark, sf_dir, "customer").select(raw.alias("raw")).distinct().select("raw", taxid.repaired(F.col("raw"), F.lit("Felipe Velazquez Solis")).alias("rfc"))
    return rows.withColumn("raw", raw).join(repairs, "raw").select("c_custkey", "prefix", "rfc")


@register("rfc14_hint_precedence", f"WITH {_ORDERS} SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE tax END AS rfc FROM o")
def hint_precedence(spark, sf_dir):
    k = F.col("id") % 4
    tax = F.col("tax")
    text = F.when(k.isin(0, 1), tax)
    hint = F.when(k == 1, F.lit("nada")).when(k == 2, tax)
    return _orders(spark, sf_dir).select("id", fields.tax_id_in_document(text, F.lit("sin"), F.lit("Uno SA"), hint).alias("rfc"))


# dates


@register("dt01_dt11_document_date", f"WITH {_ORDERS} SELECT id, CASE WHEN id % 7 = 6 THEN NULL ELSE CASE WHEN day < '2000-01-01' THEN NULL ELSE day END END AS fecha FROM o")
def document_date(spark, sf_dir):
    o, k = _orders(spark, sf_dir), F.col("id") % 7
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    months = [m for m in V.MONTHS if m != "setiembre"]
    month = F.element_at(F.array(*(F.lit(m) for m in months)), F.month("o_orderdate"))
    text = (
        F.when(k == 0, F.concat(F.lit("Fecha de entrega: "), "slashed", F.lit(" " + "z " * 200 + "01/01/2024")))
        .when(k == 1, F.concat(day, F.lit(" de "), month, F.lit(" de "), year))
        .when(k == 2, F.concat(F.lit("siendo el dia "), day, F.lit(" de "), F.month("o_orderdate").cast("string"), F.lit(" del "), year))
        .when(k == 3, F.concat(month, F.lit(" "), day, F.lit(", "), year))
        .when(k == 4, F.concat(F.lit("lo firman a los "), day, F.lit(" dias del mes de "), month, F.lit(" de "), year))
        .when(k == 5, F.concat(F.lit("emitido "), "day", F.lit(" en linea")))
        .otherwise(F.concat(F.lit("escritura publica de fecha "), "slashed"))
    )
    return o.select("id", fields.document_date(text).alias("fecha"))


@register("dt04_month_names", "SELECT n_nationkey, ['9','10','5',NULL,NULL,'1','12'][n_nationkey % 7 + 1] AS month FROM nation")
def month_names(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("sept", "oct", "MOy", "junto", "ab", "Enero", "dici"))), F.col("n_nationkey") % 7 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", fields.month_number(raw).cast("string").alias("month"))


# document type


def _typed(spark, sf_dir):
    phrases = F.array(*(F.lit(p.title()) for p in _PHRASES))
    n = len(_PHRASES)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("** Documento: "), F.coalesce(F.get(phrases, (F.col("o_orderkey") % (n + 1)).cast("int")), F.lit("otra cosa"))).alias("text"))


# what each phrase is: itself, but where a rule of more points or of an earlier place has all of its terms
_EXPECTED = f"SELECT o_orderkey AS id, coalesce({_TYPES}[CAST(o_orderkey % {len(_PHRASES) + 1} AS INTEGER) + 1], '{V.DEFAULT_TYPE}') AS tipo_documento FROM orders"


@register("typ01_typ02_document_type", _EXPECTED)
def document_type(spark, sf_dir):
    return _typed(spark, sf_dir).select("id", doctype.document_type(F.col("text")).alias("tipo_documento"))


@register("jn15_types_by_join", _EXPECTED)
def types_by_join(spark, sf_dir):
    return doctype.types_by_join(_typed(spark, sf_dir), doctype.rules_table(spark))


# names


@register("nam04_supplier_name", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE replace(s_name, '#', ' ') || ' SA DE CV' END AS nombre FROM supplier")
def supplier_name(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(" SA DE CV"))
    text = (
        F.when(k == 0, F.concat(F.lit("contrato\nPROVEEDOR: "), name, F.lit("\nRFC X")))
        .when(k == 1, F.concat(F.lit("EL CLIENTE confirma su acuerdo con "), name, F.lit(" a quien en lo sucesivo se le denominara")))
        .when(k == 2, F.concat(F.lit("EMISOR - "), name, F.lit(" CURP 123")))
        .otherwise(F.lit("PROVEEDOR: FEMSA COMERCIO"))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", fields.supplier_name(text).alias("nombre"))


@register("nam05_nam06_core_name", "SELECT s_suppkey, upper(replace(s_name, '#', ' ')) || ' SA DE CV' AS normal, upper(replace(s_name, '#', ' ')) AS core FROM supplier")
def core_name(spark, sf_dir):
    raw = F.concat(F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("  SA DE CV con RFC XAXX010101000"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", fields.match_name(raw).alias("normal"))
    return rows.withColumn("core", fields.core_name(F.col("normal")))


@register("set04_word_overlap", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CAST(1 AS DOUBLE) / 3 ELSE 0.0 END AS share FROM part")
def word_overlap(spark, sf_dir):
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", fields.word_overlap(F.lit("a b"), F.when(k == 0, "b a a").when(k == 1, "b  c").otherwise("")).alias("share"))


# quality


_QUALITY = """
q AS (SELECT o_orderkey AS id,
  [NULL, '12-1234567', 'mal', 'ABC851301AB1', 'ABC850101AB1'][o_orderkey % 5 + 1] AS rfc, o_orderkey % 5 AS r,
  [NULL, '2024-13-01', '2023-02-30', '2090-01-01', '1985-01-01', '2020-05-05'][o_orderkey % 6 + 1] AS fecha, o_orderkey % 6 AS f,
  o_orderkey % 7 % 3 AS t, o_orderkey % 4 % 3 AS n FROM orders),
c AS (SELECT *, [0.0, 0.9, 0.3, 0.5, 1.0][r + 1] AS cr, [0.0, 0.2, 0.2, 0.3, 0.4, 1.0][f + 1] AS cf, [0.0, 0.3, 1.0][t + 1] AS ct, [0.0, 0.2, 1.0][n + 1] AS cn FROM q),
s AS (SELECT *, CAST(round_even(CAST(35 * cr + 30 * cf + 20 * ct + 15 * cn AS DOUBLE), 0) AS INTEGER) AS score FROM c)
SELECT id, score, CASE WHEN score >= 85 THEN 'verde' WHEN score >= 65 THEN 'amarillo' ELSE 'rojo' END AS light,
  nullif(array_to_string(list_filter([['missing_rfc', NULL, 'invalid_rfc_format', 'invalid_rfc_date', NULL][r + 1],
   ['missing_fecha_documento', 'invalid_fecha_format', 'invalid_fecha_value', 'fecha_future', 'fecha_too_old', NULL][f + 1],
   ['missing_tipo_documento', 'tipo_documento_fallback', NULL][t + 1], ['missing_nombre_proveedor', 'nombre_proveedor_too_short', NULL][n + 1]], lambda x: x IS NOT NULL), ','), '') AS reasons
FROM s
"""


@register("qlt01_qlt06_quality", "WITH " + _QUALITY.strip())
def quality_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda i, *values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), i.cast("int"))
    q = quality.scored(
        pick(k % 5, None, "12-1234567", "mal", "ABC851301AB1", "ABC850101AB1"),
        pick(k % 6, None, "2024-13-01", "2023-02-30", "2090-01-01", "1985-01-01", "2020-05-05"),
        pick(k % 7 % 3, None, "Documentos Varios", "Comida Rapida"),
        pick(k % 4 % 3, "", " a ", "Uno"),
        2024,
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), q.alias("q"))
    return rows.select("id", F.col("q.score").alias("score"), F.col("q.traffic_light").alias("light"), quality.stored(F.col("q"))[0].alias("reasons"))


# evaluation


@register(
    "agg13_jn14_field_accuracy",
    """WITH e AS (SELECT l.doc_id, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT coalesce(field, 'overall') AS field, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS accuracy FROM (
      SELECT 'rfc' AS field, quality = 1 AS ok FROM e UNION ALL SELECT 'fecha_documento', toxic = 0 FROM e UNION ALL SELECT 'tipo_documento', doc_id % 2 = 0 FROM e UNION ALL SELECT 'nombre_proveedor', doc_id % 3 <> 0 FROM e WHERE doc_id % 5 <> 0)
    GROUP BY ROLLUP (field)""",
)
def field_accuracy(spark, sf_dir):
    k, lab = F.col("doc_id"), table(spark, sf_dir, "labels")
    name = F.concat(F.lit("f"), k.cast("string"))
    truth = lab.select(name.alias("filename"), F.lit("ABC-850101 xy1").alias("rfc_expected"), F.lit("2024-01-01").alias("fecha_documento_expected"), F.lit("Convenio Logístico").alias("tipo_documento_expected"), F.when(k % 5 != 0, "Grupo Ñandú SA").alias("nombre_proveedor_expected"))
    found = table(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id").select(
        name.alias("filename"),
        F.when(F.col("quality") == 1, "abc850101XY1").otherwise("ABC").alias("rfc"),
        F.when(F.col("toxic") == 0, " 2024-01-01 ").alias("fecha_documento"),
        F.when(k % 2 == 0, "CONVENIO LOGISTICO.").otherwise("otro").alias("tipo_documento"),
        F.when(k % 3 != 0, "nandu").otherwise("otro nombre").alias("nombre_proveedor"),
    )
    return E.accuracy(E.compared(truth, found))


# forms


@register(
    "txt09_txt11_page_quality",
    r"""SELECT item_id, length(regexp_replace(replace(replace(replace(text, ' ', ''), chr(9), ''), chr(10), ''), '[^\pL]', '', 'g')) / CAST(length(replace(replace(replace(text, ' ', ''), chr(9), ''), chr(10), '')) AS DOUBLE) AS share,
    len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]{3,}')) AS words FROM benchmark""",
)
def page_quality(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.letter_share(F.col("text")).alias("share"), T.word_count(F.col("text")).cast("long").alias("words"))


@register("txt06_type_form", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(translate(text, 'áéíóúÁÉÍÓÚñÑ', 'aeiouAEIOUnN')), '[^a-z0-9\s/&\-_]', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM documents")
def type_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.type_form(F.col("text"))).alias("form"))


@register(
    "txt12_ocr_score",
    r"""WITH t AS (SELECT n_nationkey, 'CONVENIO con Proveedor ' || n_name || ' RFC fecha ' || CASE WHEN n_nationkey % 2 = 0 THEN 'ABCDEFGHIJ0123 ' ELSE '' END || '%% 12' AS x FROM nation)
    SELECT n_nationkey, CAST(trunc(4 * 120 + length(regexp_replace(x, '[^\pL]', '', 'g')) / CAST(length(replace(x, ' ', '')) AS DOUBLE) * 40 + length(regexp_replace(x, '[^\pL\pN]', '', 'g')) / CAST(length(replace(x, ' ', '')) AS DOUBLE) * 20 - len(regexp_extract_all(x, '[A-Z0-9]{10,}')) * 10) AS INTEGER) AS score FROM t""",
)
def ocr_score(spark, sf_dir):
    text = F.concat(F.lit("CONVENIO con Proveedor "), "n_name", F.lit(" RFC fecha "), F.when(F.col("n_nationkey") % 2 == 0, "ABCDEFGHIJ0123 ").otherwise(""), F.lit("%% 12"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.ocr_score(text).alias("score"))


@register("txt08_extension", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN '' ELSE 'b/c' END AS extension FROM pages")
def extension(spark, sf_dir):
    k = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.when(k == 0, "a.b/SCAN.PDF ").when(k == 1, "none").otherwise("a.b/c")).alias("extension"))


@register(
    "srt08_sampled_pages",
    "SELECT p_partkey, CASE WHEN p_size <= 5 THEN range(0, p_size) ELSE list_sort(list_distinct([0, p_size - 1, p_size // 4, p_size * 2 // 4, p_size * 3 // 4])) END AS pages FROM part",
)
def sampled_pages(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sampled_pages(F.col("p_size")).alias("pages"))
