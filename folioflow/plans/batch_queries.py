"""Queries over batches and their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batches as B
from .registry import register
from .standins import BATCHES, DOCUMENTS, batches, documents, table

_D, _BD = "WITH " + DOCUMENTS, "WITH " + DOCUMENTS + "," + BATCHES
_DIMENSIONS = ("status", "source_type", "route", "tipo_documento", "error_category", "quality_traffic_light")
_HISTOGRAMS = " UNION ALL ".join(
    f"SELECT batch_id, '{c}' AS metric, {c} AS key, count(*) AS n FROM d {'' if c in _DIMENSIONS[:4] else f'WHERE {c} IS NOT NULL'} GROUP BY batch_id, {c}" for c in _DIMENSIONS
)
_FUSED = """SELECT batch_id, count(*) AS total, count(rfc) AS with_rfc, count(fecha_documento) AS with_fecha_documento, count(tipo_documento) AS with_tipo_documento,
  count(nombre_proveedor) AS with_nombre_proveedor,
  count(*) FILTER (WHERE rfc IS NOT NULL AND fecha_documento IS NOT NULL AND tipo_documento IS NOT NULL AND nombre_proveedor IS NOT NULL) AS with_all,
  coalesce(avg(quality_score), 0.0) AS average_quality, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_bytes FROM d GROUP BY batch_id"""


@register("agg01_histograms", f"{_D} {_HISTOGRAMS}")
def histograms(spark, sf_dir):
    return B.histograms(documents(spark, sf_dir))


@register("agg02_agg03_fused_counts", f"{_D} {_FUSED}")
def fused(spark, sf_dir):
    return B.fused(documents(spark, sf_dir))


_METRICS = f"""{_D}, f AS ({_FUSED}), h AS ({_HISTOGRAMS}),
 u AS (SELECT batch_id, 'fields' AS metric, k AS key, n, total FROM (
   SELECT batch_id, total, unnest(['rfc','fecha_documento','tipo_documento','nombre_proveedor','all']) AS k,
          unnest([with_rfc, with_fecha_documento, with_tipo_documento, with_nombre_proveedor, with_all]) AS n FROM f)),
 m AS (SELECT * FROM u UNION ALL SELECT h.batch_id, h.metric, h.key, h.n, f.total FROM h JOIN f ON h.batch_id = f.batch_id)
 SELECT batch_id, metric, key, n, round_even(CAST(n AS DOUBLE) / total * 100, 2) AS pct FROM m"""


@register("agg05_batch_metrics", _METRICS)
def metrics(spark, sf_dir):
    return B.metrics(documents(spark, sf_dir))


#: All batches, and one without documents for each.
_MORE = "SELECT id FROM b UNION ALL SELECT -1 - id FROM b"


def _more(spark, sf_dir):
    own = batches(spark, sf_dir)
    return own.unionByName(own.withColumn("id", -1 - F.col("id")))


@register("agg06_jn01_documents_per_batch", f"{_BD} SELECT b.id AS batch_id, count(d.id) AS total_documents FROM ({_MORE}) b LEFT JOIN d ON d.batch_id = b.id GROUP BY b.id")
def per_batch(spark, sf_dir):
    return B.documents_per_batch(_more(spark, sf_dir), documents(spark, sf_dir))


@register(
    "srt01_list_page",
    f"{_BD}, p AS (SELECT * FROM b WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 20 OFFSET 5) SELECT p.id, p.batch_key, p.status, p.created_at, count(d.id) AS total_documents FROM p LEFT JOIN d ON d.batch_id = p.id GROUP BY ALL",
)
def list_page(spark, sf_dir):
    return B.list_batches(batches(spark, sf_dir), documents(spark, sf_dir), limit=20, offset=5, status="completed")[0]


@register(
    "agg17_report_kpis",
    f"""{_BD}, n AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'processed') AS processed, avg(quality_score) AS quality, sum(file_size) / 1048576.0 AS mb FROM d GROUP BY batch_id)
 SELECT b.id AS batch_id, CASE WHEN b.id % 2 = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS processing_seconds, coalesce(n.total, 0) AS total_documents, coalesce(n.quality, 0.0) AS avg_quality,
 CASE WHEN b.id % 3 = 0 THEN 12.5 WHEN n.total > 0 THEN round_even(CAST(n.processed AS DOUBLE) / n.total * 100, 2) ELSE 0.0 END::DOUBLE AS success_rate, coalesce(n.mb, 0.0)::DOUBLE AS total_size_mb
 FROM ({_MORE}) b LEFT JOIN n ON n.batch_id = b.id""",
)
def report_kpis(spark, sf_dir):
    """Reports of all batches, some without documents, seconds or a share."""
    counts = documents(spark, sf_dir).groupBy("batch_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.avg("quality_score").alias("average_quality"),
        (F.sum("file_size") / F.lit(1048576.0)).alias("total_size_mb"),
    )
    reports = _more(spark, sf_dir).select(F.col("id").alias("batch_id")).join(counts, "batch_id", "left")
    k = F.col("batch_id")
    return B.kpis(reports.withColumns({"processing_seconds": F.when(k % 2 == 0, 1.5), "processed_pct": F.when(k % 3 == 0, 12.5)}))


@register("agg07_total_batches", "SELECT count(*) AS total FROM customer")
def total_batches(spark, sf_dir):
    return B.list_batches(batches(spark, sf_dir), documents(spark, sf_dir), status="failed")[1]


@register(
    "agg08_status_counts",
    f"{_D} SELECT batch_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(0 AS BIGINT) AS other FROM d GROUP BY batch_id",
)
def status_counts(spark, sf_dir):
    return B.status_counts(documents(spark, sf_dir))


@register(
    "agg09_set03_sta03_batch_status",
    f"""{_BD}, s AS (SELECT b.id AS batch_id, list_sort(list_distinct(list(CASE WHEN d.batch_id % 7 = 0 THEN 'processed' WHEN d.id % 29 = 0 THEN 'processing' ELSE d.status END) FILTER (WHERE d.id IS NOT NULL))) AS s
      FROM ({_MORE}) b LEFT JOIN d ON d.batch_id = b.id GROUP BY b.id)
    SELECT batch_id, CASE WHEN s IS NULL OR len(s) = 0 THEN 'failed' WHEN s = ['processed'] THEN 'completed' WHEN s = ['failed'] THEN 'failed'
      WHEN list_contains(s, 'processing') THEN 'processing' WHEN list_contains(s, 'failed') AND list_contains(s, 'processed') THEN 'partial' ELSE 'pending' END AS status FROM s""",
)
def batch_status(spark, sf_dir):
    status = F.when(F.col("batch_id") % 7 == 0, "processed").when(F.col("id") % 29 == 0, "processing").otherwise(F.col("status"))
    return B.batch_status(_more(spark, sf_dir), documents(spark, sf_dir).withColumn("status", status))


@register(
    "prj05_batch_detail",
    f"{_D} SELECT batch_id, count(*) AS n, string_agg(id || ':' || status || ':' || coalesce(rfc, '-'), ',' ORDER BY id) AS documents FROM d GROUP BY batch_id",
)
def detail(spark, sf_dir):
    nested = B.detail(documents(spark, sf_dir).select("batch_id", "id", "status", "rfc"))
    shown = F.transform("documents", lambda d: F.concat_ws(":", d["id"].cast("string"), d["status"], F.coalesce(d["rfc"], F.lit("-"))))
    return nested.select("batch_id", F.size("documents").cast("long").alias("n"), F.array_join(shown, ",").alias("documents"))


@register(
    "prj01_jn06_export_rows",
    f"""{_BD}, s AS (SELECT o_orderkey AS document_id, max_by('C:\\in "' || o_orderkey || '"\\' || l, l) AS path FROM orders, (VALUES (1), (2)) v(l) WHERE o_orderkey % 2 = 0 GROUP BY o_orderkey)
    SELECT batch_key, d.id AS document_id, CASE WHEN path IS NULL THEN '' ELSE '=HYPERLINK("' || replace(path, '"', '""') || '")' END AS link,
      file_size AS file_size_bytes, filename, route, d.status, rfc FROM d JOIN b ON b.id = d.batch_id LEFT JOIN s ON s.document_id = d.id""",
)
def export_rows(spark, sf_dir):
    docs, own = documents(spark, sf_dir), batches(spark, sf_dir)
    keys = own.select(F.col("id").alias("batch_id"), "batch_key")
    paths = docs.where("id % 2 = 0").join(keys, "batch_id").select("batch_key", F.concat(F.col("id").cast("string"), F.lit(".0")).alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), F.col("id").alias("i"))
    paths = paths.withColumn("source_path", F.concat(F.lit('C:\\in "'), F.col("i").cast("string"), F.lit('"\\'), F.col("ordinal").cast("string")))
    rows = docs.withColumn("processing_route", B.processing_route(F.col("route")))
    return B.export_rows(own, rows, paths).select("batch_key", "document_id", "link", "file_size_bytes", "filename", "route", "status", "rfc")


@register("prj06_processing_route", f"{_D} SELECT id, CASE route WHEN 'digital_pdf' THEN 'digital' WHEN 'ocr_image' THEN 'ocr' WHEN 'structured_document' THEN 'structured' ELSE route END AS processing_route FROM d")
def processing_route(spark, sf_dir):
    return documents(spark, sf_dir).select("id", B.processing_route(F.col("route")).alias("processing_route"))


@register("flt01_failed_documents", f"{_D} SELECT id, error_category FROM d WHERE batch_id = 7 AND status = 'failed'")
def failed(spark, sf_dir):
    return B.failed_documents(documents(spark, sf_dir), 7).select("id", "error_category")


@register(
    "flt07_agg21_upload_totals",
    """WITH f AS (SELECT CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'dir/' || p_name || '.PDF' WHEN 2 THEN p_name || '.exe' WHEN 3 THEN 'a\\b\\' || p_name || '.xlsx' ELSE p_name || '.msg' END AS name, CAST(floor(p_retailprice) * 40000 AS BIGINT) AS size FROM part),
    r AS (SELECT *, regexp_extract(name, '([^/\\\\]*)$', 1) AS base FROM f),
    q AS (SELECT *, CASE WHEN base = '' THEN 'missing filename' WHEN NOT regexp_matches(base, '\\.(pdf|PDF|xlsx|msg)$') THEN 'unsupported extension' WHEN size > 52428800 THEN 'file too large' END AS reason FROM r)
    SELECT reason, count(*) AS n, count(*) FILTER (WHERE reason IS NULL OR reason = 'file too large') AS accepted FROM q GROUP BY reason""",
)
def upload_totals(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "").when(k == 1, F.concat(F.lit("dir/"), "p_name", F.lit(".PDF"))).when(k == 2, F.concat("p_name", F.lit(".exe"))).when(k == 3, F.concat(F.lit("a\\b\\"), "p_name", F.lit(".xlsx"))).otherwise(F.concat("p_name", F.lit(".msg")))
    files = table(spark, sf_dir, "part").select(name.alias("name"), (F.floor("p_retailprice") * 40000).cast("long").alias("size"))
    return B.upload_reasons(files).groupBy("reason").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


@register(
    "jn11_duplicate_files",
    f"{_D}, g AS (SELECT file_hash, list_sort(list(id)) AS ids FROM d GROUP BY file_hash) SELECT d.id, CASE WHEN len(ids) < 2 THEN NULL WHEN ids[1] = d.id THEN ids[2] ELSE ids[1] END AS duplicate_of FROM d JOIN g ON g.file_hash = d.file_hash",
)
def duplicates(spark, sf_dir):
    return B.duplicate_of(documents(spark, sf_dir))


@register("txt24_file_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@register(
    "snk09_jn16_delete_batches",
    f"{_BD}, l AS (SELECT event_id, user_id AS document_id FROM events), g AS (SELECT id FROM b WHERE id % 3 = 0), x AS (SELECT id FROM d WHERE batch_id IN (SELECT id FROM g)) "
    "SELECT 'batches' AS kept, count(*) AS n FROM b WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'documents', count(*) FROM d WHERE batch_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'logs', count(*) FROM l WHERE document_id NOT IN (SELECT id FROM x)",
)
def delete_batches(spark, sf_dir):
    own = batches(spark, sf_dir)
    logs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"))
    left = B.delete_batches(own.where("id % 3 = 0").select("batch_key"), own, documents(spark, sf_dir), logs)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kept"), "n") for k, df in zip(("batches", "documents", "logs"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(
    "snk07_prj12_apply_results",
    f"""{_D}, r AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'failed' ELSE 'processed' END AS status FROM d WHERE status = 'pending')
    SELECT d.id, coalesce(r.status, d.status) AS status, CASE WHEN r.status IS NULL THEN d.rfc WHEN r.status = 'failed' THEN NULL ELSE 'ABC850101XY1' END AS rfc,
      CASE WHEN r.status IS NULL THEN d.quality_score WHEN r.status = 'failed' THEN d.quality_score ELSE 100 END AS quality_score,
      CASE WHEN r.status = 'processed' THEN 'verde' ELSE d.quality_traffic_light END AS quality_traffic_light FROM d LEFT JOIN r ON r.id = d.id""",
)
def apply_results(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("field_confidence_json", F.lit(None).cast("string"))
    status = F.when(F.col("id") % 10 == 0, "failed").otherwise("processed")
    results = docs.where("status = 'pending'").select("id", status.alias("status"), F.lit(None).cast("string").alias("error_category"), F.lit("ABC850101XY1").alias("rfc"), F.lit("2020-01-31").alias("fecha_documento"), F.lit("Comida Rapida").alias("tipo_documento"), F.lit("Uno Dos").alias("nombre_proveedor"))
    return B.apply_results(docs, results, 2024).select("id", "status", "rfc", "quality_score", "quality_traffic_light")


@register(
    "snk08_audit_log",
    f"{_D} SELECT id AS document_id, 'process' AS action, CASE status WHEN 'failed' THEN 'failed' ELSE 'success' END AS status, error_category FROM d WHERE status <> 'pending'",
)
def audit_log(spark, sf_dir):
    return B.log_rows(documents(spark, sf_dir).where("status <> 'pending'"), "process", "2024-01-01T00:00:00Z").select("document_id", "action", "status", "error_category")


@register("win08_stable_estimate", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stable FROM events")
def stable_estimate(spark, sf_dir):
    return B.running_minimum(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "stable")


@register(
    "agg16_list_kpis",
    f"{_BD}, p AS (SELECT b.id, b.status, count(d.id) AS n FROM b LEFT JOIN d ON d.batch_id = b.id GROUP BY b.id, b.status) SELECT count(*) AS batches, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(n) AS BIGINT) AS documents FROM p",
)
def list_kpis(spark, sf_dir):
    rows = batches(spark, sf_dir).join(B.documents_per_batch(batches(spark, sf_dir), documents(spark, sf_dir)), F.col("id") == F.col("batch_id"))
    return rows.agg(F.count("*").alias("batches"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("total_documents").alias("documents"))


@register("srt05_histogram_order", f"{_D} SELECT tipo_documento, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tipo_documento) AS place FROM d WHERE tipo_documento IS NOT NULL GROUP BY tipo_documento")
def histogram_order(spark, sf_dir):
    from pyspark.sql import Window

    counts = documents(spark, sf_dir).where("tipo_documento IS NOT NULL").groupBy("tipo_documento").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "tipo_documento")).cast("long"))  # a row for each type


@register(
    "txt25_txt26_ids_and_clock",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderkey + 1 END AS id, CASE WHEN floor(o_totalprice) < 3600 THEN lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(o_totalprice) AS BIGINT) // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock FROM orders",
)
def ids_and_clock(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise((k + 1).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.whole_id(raw).alias("id"), T.clock(F.floor("o_totalprice")).alias("clock"))
