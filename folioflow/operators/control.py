"""The control table of a manifest: pairing with files, tracking, the next batch and its life."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import text as T

MANIFEST_HEADERS = {"Concatenado": "concatenado", "Name": "name", "Extension": "extension", "Attributes.Size": "attributes_size", "Size KB": "size_kb", "Bandera": "bandera_source"}
RELEASABLE = ("uploaded", "pending", "processing")


def normal_manifest(manifest: DataFrame, ordinal: str) -> DataFrame:
    """A manifest with its keys. ``ordinal`` gives the rows' order from 0; the first is row 2 of the sheet."""
    named = {c.strip(): c for c in manifest.columns}
    missing = sorted(set(MANIFEST_HEADERS) - set(named))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    m = manifest.select((F.col(ordinal) + 2).cast("int").alias("manifest_row"), *(F.col(f"`{named[k]}`").alias(v) for k, v in MANIFEST_HEADERS.items()))
    clean = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    m = m.withColumns({"name": clean("name"), "extension": clean("extension"), "bandera_source": F.lower(clean("bandera_source"))})
    m = m.withColumns(
        {
            "extension_normalized": F.regexp_replace(F.lower("extension"), r"^\.+", ""),
            "attributes_size": F.coalesce(F.col("attributes_size").cast("string").try_cast("double"), F.lit(-1.0)).cast("bigint"),
            "size_kb": F.col("size_kb").cast("string").try_cast("double"),
            "match_name": F.lower("name"),
        }
    )
    m = m.withColumns({"match_size": F.col("attributes_size"), "is_supported": F.col("extension_normalized").isin(*V.SUPPORTED_TYPES)})
    return numbered(m, "manifest_row").withColumn("control_key", F.concat_ws("|", "match_name", F.col("match_size").cast("string"), F.col("match_seq").cast("string")))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``match_seq``: which of the rows of one name and size a row is, from 0."""
    return rows.withColumn("match_seq", F.row_number().over(Window.partitionBy("match_name", "match_size").orderBy(order)) - 1)


def paired(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Each manifest row with the file of its name, size and number, and the tracking it starts with."""
    rows = manifest.join(index, ["match_name", "match_size", "match_seq"], "left")
    lost = F.col("source_path").isNull()
    status = F.when(lost, "missing_source").when(~F.col("is_supported"), "unsupported_extension").when(F.col("bandera_source") != "procesar", "skipped_manifest_processed").otherwise("pending")
    fresh = {name: F.lit(None).cast(kind) for name, kind in V.TRACKING if name != "tracking_status" and name not in rows.columns}
    return rows.withColumns({"path_status": F.when(lost, "missing_source").otherwise("matched"), "tracking_status": status, **fresh})


def with_tracking(control: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Control rows with what an earlier table knows of them; what is stored and not null wins."""
    if stored is None:
        return control
    names = [n for n, _ in V.TRACKING if n in stored.columns]
    old = stored.select("control_key", *(F.col(n).alias(f"__{n}") for n in names))
    merged = control.join(old, "control_key", "left")
    return merged.withColumns({n: F.coalesce(f"__{n}", n) if n in control.columns else F.col(f"__{n}") for n in names}).drop(*(f"__{n}" for n in names))


def next_batch(control: DataFrame, limit: int = 300) -> DataFrame:
    return control.where("tracking_status = 'pending'").orderBy("manifest_row", "name").limit(limit)


def prepared(control: DataFrame, selected: DataFrame, saved: DataFrame, batch_key: str, at: str) -> DataFrame:
    """Selected rows and stored files, both in order by ``ordinal``, are joined one to one and marked uploaded."""
    sizes = selected.agg(F.count("*").alias("a")).crossJoin(saved.agg(F.count("*").alias("b"))).first()  # one row each
    if sizes.a != sizes.b:
        raise ValueError(f"{sizes.a} rows were selected, {sizes.b} files stored")
    pairs = selected.select("ordinal", "control_key").join(saved.select("ordinal", *(F.col(c).alias(f"__{c}") for c in ("document_id", "stored_filename", "saved_path"))), "ordinal").drop("ordinal")
    rows = control.join(pairs.withColumn("__hit", F.lit(True)), "control_key", "left")
    hit = F.col("__hit").isNotNull()
    new = {"tracking_status": F.lit("uploaded"), "batch_key": F.lit(batch_key), "batch_document_id": F.col("__document_id"), "stored_filename": F.col("__stored_filename"), "saved_path": F.col("__saved_path"), "prepared_at": F.lit(at), "batch_status": F.lit("pending")}
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(*control.columns)


def finalized(control: DataFrame, documents: DataFrame, batch_key: str, batch_status: str, at: str, export_path: str) -> DataFrame:
    """Control rows of a batch with what became of their documents ``(document_id, status, ...)``."""
    copied = [n for n in ("route", "processing_route", "rfc", "fecha_documento", "tipo_documento", "nombre_proveedor", "quality_score", "quality_traffic_light", "quality_reasons", "error_message")]
    docs = documents.select(F.col("document_id").alias("__id"), F.col("status").alias("__status"), *(F.col(n).alias(f"__{n}") for n in copied), F.lit(True).alias("__hit"))
    rows = control.join(docs, (F.col("batch_key") == batch_key) & (F.col("batch_document_id") == F.col("__id")), "left")
    tracking = F.when(F.col("__status").isin("processed", "failed"), F.col("__status")).otherwise("uploaded")
    new = {"tracking_status": tracking, "batch_status": F.lit(batch_status), "document_status": F.col("__status"), "finalized_at": F.lit(at), "export_xlsx_path": F.lit(export_path), **{n: F.col(f"__{n}") for n in copied}}
    hit = F.col("__hit").isNotNull()
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).select(*control.columns)


def released(control: DataFrame, batch_key: str) -> DataFrame:
    """Rows of a batch that is called off are pending again, without a trace."""
    hit = F.coalesce((F.col("batch_key") == batch_key) & F.col("tracking_status").isin(*RELEASABLE), F.lit(False))
    cleared = {n: F.when(hit, F.lit("pending") if n == "tracking_status" else F.lit(None)).otherwise(F.col(n)) for n, _ in V.TRACKING if n in control.columns}
    return control.withColumns(cleared)


def summary(control: DataFrame) -> DataFrame:
    """A row for each batch: files, first time, last status, documents done and failed, last export; newest first."""
    row = F.col("manifest_row")
    known = lambda c: F.when(F.col(c).isNotNull(), row)
    return (
        control.where("batch_key IS NOT NULL")
        .groupBy("batch_key")
        .agg(
            F.count("control_key").alias("files_in_batch"),
            F.min_by("prepared_at", known("prepared_at")).alias("prepared_at"),
            F.max_by("batch_status", known("batch_status")).alias("batch_status"),
            F.count_if(F.col("document_status") == "processed").alias("processed_documents"),
            F.count_if(F.col("document_status") == "failed").alias("failed_documents"),
            F.max_by("export_xlsx_path", known("export_xlsx_path")).alias("export_xlsx_path"),
        )
        .orderBy(F.desc_nulls_last("prepared_at"), F.desc("batch_key"))
    )


def tracking_counts(control: DataFrame) -> DataFrame:
    return control.groupBy(F.coalesce("tracking_status", F.lit("unknown")).alias("tracking_status")).agg(F.count("*").alias("n"))


def released_count(before: DataFrame, after: DataFrame, batch_key: str) -> DataFrame:
    """How many rows a release has taken out of a batch."""
    now = after.select("control_key", F.col("batch_key").alias("__now"))
    return before.join(now, "control_key").agg(F.count_if((F.col("batch_key") == batch_key) & F.col("__now").isNull()).alias("released"))


def stored_paths(control: DataFrame, ordinal: str, batch_key: str | None = None) -> DataFrame:
    """``batch_key, batch_document_id, source_path`` that a control table holds, of one batch or of all; of repeated documents the last row's.

    No rows if one of these columns is missing. Rows without a batch, a whole id or a path are left out.
    """
    if not {"batch_key", "batch_document_id", "source_path"}.issubset(control.columns):
        return control.sparkSession.createDataFrame([], "batch_key string, batch_document_id long, source_path string")
    rows = control.select(
        F.col("batch_key").cast("string").alias("batch_key"),
        T.whole_id(F.col("batch_document_id").cast("string")).cast("long").alias("batch_document_id"),
        F.btrim(F.coalesce(F.col("source_path").cast("string"), F.lit(""))).alias("source_path"),
        F.col(ordinal).alias("o"),
    ).where("batch_key IS NOT NULL AND batch_document_id IS NOT NULL AND source_path <> ''")
    if batch_key is not None:
        rows = rows.where(F.col("batch_key") == batch_key)
    return rows.groupBy("batch_key", "batch_document_id").agg(F.max_by("source_path", "o").alias("source_path"))
