"""Quality of a document's four fields: confidences, weighted score, traffic light and reasons, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from . import taxid


def _graded(*cases: tuple[Column, float, str | None], otherwise: float) -> Column:
    """Confidence and reason of the first case that holds."""
    kind = "struct<confidence:double,reason:string>"
    out = None
    for holds, confidence, reason in cases:
        value = F.struct(F.lit(float(confidence)).alias("confidence"), F.lit(reason).cast("string").alias("reason")).cast(kind)
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(F.struct(F.lit(float(otherwise)).alias("confidence"), F.lit(None).cast("string").alias("reason")).cast(kind))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def tax_id(c: Column) -> Column:
    return _graded(
        (_missing(c), 0.0, "missing_rfc"),
        (c.rlike(V.FOREIGN_FORMAT), 0.9, None),
        (~c.rlike(V.RFC_FORMAT), 0.3, "invalid_rfc_format"),
        (~taxid.date_is_real(c), 0.5, "invalid_rfc_date"),
        otherwise=1.0,
    )


def date(c: Column, as_of_year: int) -> Column:
    day = F.try_to_date(c, "yyyy-MM-dd")
    return _graded(
        (_missing(c), 0.0, "missing_fecha_documento"),
        (~c.rlike(V.DATE_FORMAT), 0.2, "invalid_fecha_format"),
        (day.isNull(), 0.2, "invalid_fecha_value"),
        (F.year(day) > as_of_year + V.DATE_YEARS_AHEAD, 0.3, "fecha_future"),
        (F.year(day) < V.DATE_MIN_YEAR, 0.4, "fecha_too_old"),
        otherwise=1.0,
    )


def document_type(c: Column) -> Column:
    return _graded((_missing(c), 0.0, "missing_tipo_documento"), (c == V.DEFAULT_TYPE, 0.3, "tipo_documento_fallback"), otherwise=1.0)


def supplier(c: Column) -> Column:
    short = F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) < V.NAME_MIN_LENGTH
    return _graded((_missing(c), 0.0, "missing_nombre_proveedor"), (short, 0.2, "nombre_proveedor_too_short"), otherwise=1.0)


def scored(rfc: Column, fecha: Column, tipo: Column, nombre: Column, as_of_year: int) -> Column:
    """Struct of score (half to even), traffic light, reasons in field order and confidences by field."""
    fields = {"rfc": tax_id(rfc), "fecha_documento": date(fecha, as_of_year), "tipo_documento": document_type(tipo), "nombre_proveedor": supplier(nombre)}
    total = sum((f["confidence"] * V.WEIGHTS[k] for k, f in fields.items()), F.lit(0.0))
    score = F.bround(total).cast("int")
    light = F.when(score >= V.GREEN_MIN, "verde").when(score >= V.YELLOW_MIN, "amarillo").otherwise("rojo")
    return F.struct(
        score.alias("score"),
        light.alias("traffic_light"),
        F.array_compact(F.array(*(f["reason"] for f in fields.values()))).alias("reasons"),
        F.create_map(*(x for k, f in fields.items() for x in (F.lit(k), f["confidence"]))).alias("field_confidence"),
    )


def stored(quality: Column) -> tuple[Column, Column]:
    """Reasons joined by commas, null if there are none, and confidences as JSON."""
    return F.nullif(F.array_join(quality["reasons"], ","), F.lit("")), F.to_json(quality["field_confidence"])
