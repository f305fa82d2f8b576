"""Field accuracy against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxid
from ..functions import text as T

FIELDS = ("rfc", "fecha_documento", "tipo_documento", "nombre_proveedor")


def matches(field: str, expected: Column, extracted: Column) -> Column:
    """Whether an extracted value counts as the expected one; two empty ones do."""
    if field == "rfc":
        return taxid.match_key(expected) == taxid.match_key(extracted)
    if field == "fecha_documento":
        return F.btrim(F.coalesce(expected, F.lit(""))) == F.btrim(F.coalesce(extracted, F.lit("")))
    a, b = T.evaluation_form(expected), T.evaluation_form(extracted)
    if field == "tipo_documento":
        return a == b
    return F.when((a == "") | (b == ""), a == b).otherwise(a.contains(b) | b.contains(a))


def compared(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """Expected and extracted values side by side by file name, each with its verdict."""
    found = extracted.select("filename", *(F.col(f).alias(f"{f}_extracted") for f in FIELDS))
    rows = truth.join(found, "filename")
    return rows.withColumns({f"{f}_match": matches(f, F.col(f"{f}_expected"), F.col(f"{f}_extracted")) for f in FIELDS})


def accuracy(rows: DataFrame) -> DataFrame:
    """``field, correct, total, accuracy`` where something is expected, and a row ``overall``."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.btrim(f"{f}_expected"), F.lit("")).alias("expected"), F.col(f"{f}_match").alias("ok")) for f in FIELDS))
    counted = rows.select(F.explode(pairs).alias("p")).where(F.col("p.expected") != "")
    return counted.rollup("p.field").agg(F.count_if("p.ok").alias("correct"), F.count("*").alias("total")).select(
        F.coalesce("field", F.lit("overall")).alias("field"), "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy")
    )
