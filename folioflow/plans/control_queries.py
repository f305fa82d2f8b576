"""Queries over the control table of a manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from .registry import register
from .standins import CONTROL, control, table

_K = "WITH " + CONTROL


def _manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("ordinal"),
        F.lit("c").alias("Concatenado"),
        F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")).alias(" Name "),
        F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, "xlsx").otherwise("exe").alias("Extension"),
        F.when(k % 9 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("Attributes.Size"),
        F.lit("1.5").alias("Size KB"),
        F.when(k % 5 == 0, "Ignorar").otherwise(" PROCESAR").alias("Bandera"),
    )


_MANIFEST = """
m AS (SELECT CAST(doc_id + 2 AS INTEGER) AS manifest_row, lower(lang) AS match_name, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE n_chars END AS match_size,
  doc_id % 3 <> 2 AS is_supported, CASE WHEN doc_id % 5 = 0 THEN 'ignorar' ELSE 'procesar' END AS flag FROM documents),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY match_name, match_size ORDER BY manifest_row) - 1 AS INTEGER) AS match_seq FROM m),
i AS (SELECT lower(lang) AS match_name, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1000000 ELSE n_chars END AS match_size, 'p/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS source_path FROM documents),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY match_name, match_size ORDER BY source_path) - 1 AS INTEGER) AS match_seq FROM i)
"""


def _index(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    size = F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1_000_000).otherwise(F.col("n_chars"))  # sizes that no manifest row has
    rows = d.select(F.lower("lang").alias("match_name"), size.alias("match_size"), F.concat(F.lit("p/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("source_path"))
    return C.numbered(rows, "source_path")


@register("prj03_prj04_win01_manifest_keys", f"WITH {_MANIFEST} SELECT manifest_row, is_supported, flag AS bandera_source, match_seq, match_name || '|' || match_size || '|' || match_seq AS control_key FROM n")
def manifest_keys(spark, sf_dir):
    return C.normal_manifest(_manifest(spark, sf_dir), "ordinal").select("manifest_row", "is_supported", "bandera_source", "match_seq", "control_key")


@register("src03_win02_file_index", f"WITH {_MANIFEST} SELECT source_path, match_seq FROM x")
def file_index(spark, sf_dir):
    return _index(spark, sf_dir).select("source_path", "match_seq")


@register(
    "set02_stored_paths",
    """WITH c AS (SELECT doc_id AS o, lang AS batch_key, doc_id // 2 AS id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'p/' || doc_id END AS path FROM documents WHERE lang IS NOT NULL)
 SELECT batch_key, id AS batch_document_id, arg_max(path, o) AS source_path FROM c WHERE path <> '' AND o % 7 <> 0 GROUP BY batch_key, id""",
)
def stored_paths(spark, sf_dir):
    """A control table in which every seventh id is no whole number and every eleventh path is blank."""
    k = F.col("doc_id")
    half = F.floor(k / 2).cast("string")
    control = table(spark, sf_dir, "documents").select(
        k.alias("o"),
        F.col("lang").alias("batch_key"),
        F.concat(half, F.when(k % 7 == 0, ".5").when(k % 3 == 0, ".0").otherwise("")).alias("batch_document_id"),
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" p/"), k.cast("string"), F.lit(" "))).alias("source_path"),
    )
    return C.stored_paths(control, "o")


@register(
    "jn02_prj07_prj08_pairing",
    f"""WITH {_MANIFEST} SELECT n.manifest_row, x.source_path, CASE WHEN x.source_path IS NULL THEN 'missing_source' ELSE 'matched' END AS path_status,
    CASE WHEN x.source_path IS NULL THEN 'missing_source' WHEN NOT is_supported THEN 'unsupported_extension' WHEN flag <> 'procesar' THEN 'skipped_manifest_processed' ELSE 'pending' END AS tracking_status
    FROM n LEFT JOIN x ON n.match_name = x.match_name AND n.match_size = x.match_size AND n.match_seq = x.match_seq""",
)
def pairing(spark, sf_dir):
    rows = C.paired(C.normal_manifest(_manifest(spark, sf_dir), "ordinal"), _index(spark, sf_dir))
    return rows.select("manifest_row", "source_path", "path_status", "tracking_status")


@register(
    "jn03_prj10_stored_tracking",
    f"{_K}, s AS (SELECT control_key, 'kept' AS tracking_status, CASE WHEN manifest_row % 2 = 0 THEN 'OLD' END AS batch_key FROM k WHERE manifest_row % 3 = 0) SELECT k.control_key, coalesce(s.tracking_status, k.tracking_status) AS tracking_status, coalesce(s.batch_key, k.batch_key) AS batch_key FROM k LEFT JOIN s ON s.control_key = k.control_key",
)
def stored_tracking(spark, sf_dir):
    own = control(spark, sf_dir)
    stored = own.where("manifest_row % 3 = 0").select("control_key", F.lit("kept").alias("tracking_status"), F.when(F.col("manifest_row") % 2 == 0, "OLD").alias("batch_key"))
    return C.with_tracking(own, stored).select("control_key", "tracking_status", "batch_key")


@register("srt02_next_batch", f"{_K} SELECT manifest_row, name, control_key FROM k WHERE tracking_status = 'pending' ORDER BY manifest_row, name LIMIT 50")
def next_batch(spark, sf_dir):
    return C.next_batch(control(spark, sf_dir), 50).select("manifest_row", "name", "control_key")


@register(
    "agg10_srt04_batch_summary",
    f"""{_K} SELECT batch_key, count(control_key) AS files_in_batch, first(prepared_at ORDER BY manifest_row) FILTER (WHERE prepared_at IS NOT NULL) AS prepared_at,
    last(batch_status ORDER BY manifest_row) FILTER (WHERE batch_status IS NOT NULL) AS batch_status, count(*) FILTER (WHERE document_status = 'processed') AS processed_documents,
    count(*) FILTER (WHERE document_status = 'failed') AS failed_documents, last(export_xlsx_path ORDER BY manifest_row) FILTER (WHERE export_xlsx_path IS NOT NULL) AS export_xlsx_path
    FROM k WHERE batch_key IS NOT NULL GROUP BY batch_key""",
)
def batch_summary(spark, sf_dir):
    return C.summary(control(spark, sf_dir))


@register("agg11_tracking_counts", f"{_K} SELECT coalesce(tracking_status, 'unknown') AS tracking_status, count(*) AS n FROM k GROUP BY ALL")
def tracking_counts(spark, sf_dir):
    return C.tracking_counts(control(spark, sf_dir))


@register(
    "sta05_release",
    f"{_K} SELECT control_key, CASE WHEN batch_key = 'B1' AND tracking_status IN ('uploaded', 'pending', 'processing') THEN 'pending' ELSE tracking_status END AS tracking_status, CASE WHEN batch_key = 'B1' AND tracking_status IN ('uploaded', 'pending', 'processing') THEN NULL ELSE batch_key END AS batch_key FROM k",
)
def release(spark, sf_dir):
    return C.released(control(spark, sf_dir), "B1").select("control_key", "tracking_status", "batch_key")


@register("agg15_released_rows", f"{_K} SELECT count(*) FILTER (WHERE batch_key = 'B1' AND tracking_status = 'uploaded') AS released FROM k")
def released_rows(spark, sf_dir):
    own = control(spark, sf_dir)
    return C.released_count(own, C.released(own, "B1"), "B1")


@register(
    "jn04_prepared_batch",
    f"{_K}, p AS (SELECT control_key, row_number() OVER (ORDER BY manifest_row, name) AS o FROM k WHERE tracking_status = 'pending' QUALIFY o <= 30) SELECT k.control_key, CASE WHEN o IS NULL THEN k.tracking_status ELSE 'uploaded' END AS tracking_status, CASE WHEN o IS NULL THEN k.batch_key ELSE 'NEW' END AS batch_key, CASE WHEN o IS NULL THEN k.batch_document_id ELSE 1000 + o END AS batch_document_id FROM k LEFT JOIN p ON p.control_key = k.control_key",
)
def prepared_batch(spark, sf_dir):
    from pyspark.sql import Window

    own = control(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("stored_filename", "saved_path")})
    # a batch's rows are few
    chosen = C.next_batch(own, 30).withColumn("ordinal", F.row_number().over(Window.orderBy("manifest_row", "name")))
    saved = spark.range(1, chosen.count() + 1).select(F.col("id").cast("int").alias("ordinal"), (1000 + F.col("id")).alias("document_id"), F.lit("f").alias("stored_filename"), F.lit("p").alias("saved_path"))
    return C.prepared(own, chosen, saved, "NEW", "2024-01-01T00:00:00+00:00").select("control_key", "tracking_status", "batch_key", "batch_document_id")


@register(
    "jn05_prj11_finalized_batch",
    f"{_K} SELECT control_key, CASE WHEN batch_key = 'B2' AND batch_document_id % 2 = 0 THEN CASE WHEN batch_document_id % 3 = 0 THEN 'failed' WHEN batch_document_id % 3 = 1 THEN 'processed' ELSE 'uploaded' END ELSE tracking_status END AS tracking_status, CASE WHEN batch_key = 'B2' AND batch_document_id % 2 = 0 THEN 'completed' ELSE batch_status END AS batch_status FROM k",
)
def finalized_batch(spark, sf_dir):
    own = control(spark, sf_dir)
    texts = ("route", "processing_route", "fecha_documento", "tipo_documento", "nombre_proveedor", "quality_traffic_light", "quality_reasons", "error_message", "finalized_at")
    own = own.withColumns({**{c: F.lit(None).cast("string") for c in texts}, "quality_score": F.lit(None).cast("int")})
    k = F.col("batch_document_id") % 3
    docs = own.where("batch_key = 'B2' AND batch_document_id % 2 = 0").select(
        F.col("batch_document_id").alias("document_id"), F.when(k == 0, "failed").when(k == 1, "processed").otherwise("pending").alias("status"), "rfc", *(c for c in texts if c != "finalized_at"), "quality_score"
    )
    return C.finalized(own, docs, "B2", "completed", "2024-01-02", "out.xlsx").select("control_key", "tracking_status", "batch_status")
