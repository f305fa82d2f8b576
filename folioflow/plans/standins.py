"""Tables of the engine made from the star schema's, and the SQL that makes the same ones.

Orders stand for documents, customers for batches, suppliers for the supplier dimension. What orders
lack is derived from their keys, so that every value has gaps and all statuses occur together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (key % n + 1).cast("int"))
    score = (key * 7 % 101).cast("int")
    processed = F.col("o_orderstatus") == "O"
    return o.select(
        key.alias("id"),
        F.col("o_custkey").alias("batch_id"),
        F.concat(F.lit("doc"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        pick(4, "pdf", "xlsx", "png", "msg").alias("source_type"),
        pick(4, "digital_pdf", "structured_document", "ocr_image", "structured_document").alias("route"),
        F.when(processed, "processed").when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"),
        F.when(F.col("o_orderstatus") == "F", pick(3, "file_not_found", "extraction_empty", "processing_error")).alias("error_category"),
        F.when(processed & (key % 3 != 0), F.concat(F.lit("ABC850101"), F.lpad((key % 1000).cast("string"), 3, "0"))).alias("rfc"),
        F.when(processed & (key % 5 != 0), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha_documento"),
        F.when(processed, F.when(key % 4 == 0, "Documentos Varios").when(key % 4 == 1, "Comida Rapida").when(key % 4 == 2, "Convenio Logistico")).alias("tipo_documento"),
        F.when(processed & (key % 7 != 0), F.concat(F.lit("Proveedor "), (key % 50).cast("string"))).alias("nombre_proveedor"),
        F.when(processed, score).alias("quality_score"),
        F.when(processed, F.when(score >= 85, "verde").when(score >= 65, "amarillo").otherwise("rojo")).alias("quality_traffic_light"),
        F.when(key % 11 != 0, F.floor("o_totalprice").cast("long")).alias("file_size"),
        F.sha2((key % 9000).cast("string"), 256).alias("file_hash"),
        F.concat(F.lit("data/incoming/"), key.cast("string"), F.lit(".pdf")).alias("file_path"),
        F.lit(None).cast("string").alias("quality_reasons"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit("application/pdf").alias("mime_type"),
    )


DOCUMENTS = """
d AS (SELECT o_orderkey AS id, o_custkey AS batch_id, 'doc' || o_orderkey || '.pdf' AS filename,
  ['pdf','xlsx','png','msg'][o_orderkey % 4 + 1] AS source_type,
  ['digital_pdf','structured_document','ocr_image','structured_document'][o_orderkey % 4 + 1] AS route,
  CASE o_orderstatus WHEN 'O' THEN 'processed' WHEN 'F' THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN ['file_not_found','extraction_empty','processing_error'][o_orderkey % 3 + 1] END AS error_category,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN 'ABC850101' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS rfc,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha_documento,
  CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Documentos Varios' WHEN 1 THEN 'Comida Rapida' WHEN 2 THEN 'Convenio Logistico' END END AS tipo_documento,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 THEN 'Proveedor ' || o_orderkey % 50 END AS nombre_proveedor,
  CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey * 7 % 101 AS INTEGER) END AS quality_score,
  CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey * 7 % 101 >= 85 THEN 'verde' WHEN o_orderkey * 7 % 101 >= 65 THEN 'amarillo' ELSE 'rojo' END END AS quality_traffic_light,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS file_size,
  sha256(CAST(o_orderkey % 9000 AS VARCHAR)) AS file_hash, 'data/incoming/' || o_orderkey || '.pdf' AS file_path
  FROM orders)
"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.concat(F.lit("BATCH-20240101-"), F.lpad(key.cast("string"), 6, "0"), F.lit("-abcdef")).alias("batch_key"),
        F.element_at(F.array(*(F.lit(s) for s in ("pending", "processing", "completed", "failed", "partial"))), (key % 5 + 1).cast("int")).alias("status"),
        F.timestamp_seconds(1_700_000_000 + key * 37 % 1000 * 60).cast("timestamp_ntz").alias("created_at"),
    )


BATCHES = """
b AS (SELECT c_custkey AS id, 'BATCH-20240101-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-abcdef' AS batch_key,
  ['pending','processing','completed','failed','partial'][c_custkey % 5 + 1] AS status,
  make_timestamp(CAST((1700000000 + c_custkey * 37 % 1000 * 60) * 1000000 AS BIGINT)) AS created_at FROM customer)
"""


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows in every state of tracking, from documents of text."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    state = F.element_at(F.array(*(F.lit(s) for s in ("pending", "uploaded", "processed", "failed", "missing_source", None))), (key % 6 + 1).cast("int"))
    in_batch = (key % 6).isin(1, 2, 3)
    number = F.floor(key / 40)
    return d.select(
        (key + 2).cast("int").alias("manifest_row"),
        F.concat(F.col("lang"), F.lit("-"), F.col("source")).alias("name"),
        F.concat_ws("|", "lang", key.cast("string")).alias("control_key"),
        state.alias("tracking_status"),
        F.when(in_batch, F.concat(F.lit("B"), number.cast("string"))).alias("batch_key"),
        F.when(in_batch, key).alias("batch_document_id"),
        F.when(in_batch & (key % 4 != 0), F.concat(F.lit("2024-01-"), F.lpad((number % 28 + 1).cast("string"), 2, "0"))).alias("prepared_at"),
        F.when(in_batch & (key % 5 != 0), F.when(key % 2 == 0, "completed").otherwise("pending")).alias("batch_status"),
        F.when(key % 6 == 2, "processed").when(key % 6 == 3, "failed").alias("document_status"),
        F.when(key % 12 == 2, F.concat(F.lit("x"), key.cast("string"))).alias("export_xlsx_path"),
        F.lit(None).cast("string").alias("rfc"),
    )


CONTROL = """
k AS (SELECT CAST(doc_id + 2 AS INTEGER) AS manifest_row, lang || '-' || source AS name, lang || '|' || doc_id AS control_key,
  ['pending','uploaded','processed','failed','missing_source',NULL][doc_id % 6 + 1] AS tracking_status,
  CASE WHEN doc_id % 6 IN (1,2,3) THEN 'B' || doc_id // 40 END AS batch_key,
  CASE WHEN doc_id % 6 IN (1,2,3) THEN doc_id END AS batch_document_id,
  CASE WHEN doc_id % 6 IN (1,2,3) AND doc_id % 4 <> 0 THEN '2024-01-' || lpad(CAST(doc_id // 40 % 28 + 1 AS VARCHAR), 2, '0') END AS prepared_at,
  CASE WHEN doc_id % 6 IN (1,2,3) AND doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'pending' END END AS batch_status,
  CASE doc_id % 6 WHEN 2 THEN 'processed' WHEN 3 THEN 'failed' END AS document_status,
  CASE WHEN doc_id % 12 = 2 THEN 'x' || doc_id END AS export_xlsx_path
  FROM documents)
"""
