"""From texts to scored documents: the single-batch pipeline as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import doctype, fields, quality
from ..session import settled
from . import vendors as suppliers


def parsed(documents: DataFrame) -> DataFrame:
    """``documents (id, raw_text, rfc_hint, fecha_hint)`` with their four fields; hints win where they hold."""
    rows = documents.withColumn("tipo_documento", doctype.document_type(F.col("raw_text")))
    rows = rows.withColumns(
        {
            "text_id": fields.tax_id(F.col("raw_text")),
            "fecha_documento": F.coalesce(F.nullif(F.col("fecha_hint"), F.lit("")), fields.document_date(F.col("raw_text"), F.col("tipo_documento"))),
            "nombre_proveedor": fields.supplier_name(F.col("raw_text")),
        }
    )
    return rows.withColumn("rfc", fields.tax_id_in_document(F.col("text_id"), F.col("raw_text"), F.col("nombre_proveedor"), F.col("rfc_hint"))).drop("text_id")


def completed(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """Gaps filled by the supplier dimension; where both fields are empty, by what the path says."""
    keys = rows.select("id", "rfc", "nombre_proveedor")
    filled = settled(suppliers.filled(keys, vendors))
    empty = filled.where("rfc IS NULL AND nombre_proveedor IS NULL").join(rows.select("id", "file_path"), "id")
    paths = suppliers.from_paths(empty.select(F.col("id").alias("key"), F.col("file_path").alias("path")), vendors)
    paths = paths.select(F.col("key").alias("id"), F.col("rfc").alias("__rfc"), F.col("nombre_proveedor").alias("__name"))
    whole = filled.join(paths, "id", "left").select("id", F.coalesce("rfc", "__rfc").alias("rfc"), F.coalesce("nombre_proveedor", "__name").alias("nombre_proveedor"))
    return rows.drop("rfc", "nombre_proveedor").join(whole, "id")


def processed(documents: DataFrame, vendors: DataFrame, as_of_year: int) -> DataFrame:
    """``id, status, error_category``, the four fields and the quality of each document; without text a document fails.

    Several joins read the parsed fields, the suppliers and the filled keys, so these are checkpointed; texts are
    parsed once and not kept.
    """
    empty = F.btrim(F.coalesce("raw_text", F.lit(""))) == ""
    rows = parsed(documents).withColumn("empty", empty).drop("raw_text", "rfc_hint", "fecha_hint")
    done = completed(settled(rows), settled(vendors))
    q = quality.scored(F.col("rfc"), F.col("fecha_documento"), F.col("tipo_documento"), F.col("nombre_proveedor"), as_of_year)
    reasons, confidence = quality.stored(F.col("q"))
    only = lambda c: F.when(~F.col("empty"), c)
    return done.withColumn("q", q).select(
        "id",
        F.when(F.col("empty"), "failed").otherwise("processed").alias("status"),
        F.when(F.col("empty"), "extraction_empty").alias("error_category"),
        *(only(F.col(f)).alias(f) for f in ("rfc", "fecha_documento", "tipo_documento", "nombre_proveedor")),
        only(F.col("q.score")).alias("quality_score"),
        only(F.col("q.traffic_light")).alias("quality_traffic_light"),
        only(reasons).alias("quality_reasons"),
        only(confidence).alias("field_confidence_json"),
    )
