"""Batches of documents: status, lists, detail, metrics, export, processing results, retry and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import quality
from ..functions import text as T

SORT_COLUMNS = ("created_at", "batch_key", "status")
#: Statuses that a list may be filtered by; ``partial`` is not among them unless asked for.
LIST_STATUSES = ("pending", "processing", "completed", "failed")
FIELDS = ("rfc", "fecha_documento", "tipo_documento", "nombre_proveedor")


def check_batch_key(key: str) -> str:
    import re

    if not re.fullmatch(V.BATCH_KEY_PATTERN, key or ""):
        raise ValueError(f"not a batch key: {key!r}")
    return key


def status_of(statuses: Column) -> Column:
    """A batch's status from the set of its documents' statuses."""
    has = lambda s: F.array_contains(statuses, s)
    return (
        F.when(F.size(statuses) == 0, "failed")
        .when((F.size(statuses) == 1) & has("processed"), "completed")
        .when((F.size(statuses) == 1) & has("failed"), "failed")
        .when(has("processing"), "processing")
        .when(has("failed") & has("processed"), "partial")
        .otherwise("pending")
    )


def batch_status(batches: DataFrame, documents: DataFrame) -> DataFrame:
    """``batch_id, status`` of every batch, also of those without documents."""
    own = documents.groupBy("batch_id").agg(F.collect_set("status").alias("statuses"))
    none = F.array().cast("array<string>")
    return batches.select(F.col("id").alias("batch_id")).join(own, "batch_id", "left").select("batch_id", status_of(F.coalesce("statuses", none)).alias("status"))


#: Ids of a page that are broadcast at most.
MOST_BROADCAST = 100_000


def list_batches(batches: DataFrame, documents: DataFrame, limit: int | None = 50, offset: int = 0, status: str | None = None, sort_by: str = "created_at", descending: bool = True, allow_partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of batches with their number of documents, and the total, which no filter changes. Without a limit all from ``offset`` on."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}")
    if status is not None and status not in (*LIST_STATUSES, *(("partial",) if allow_partial else ())):
        raise ValueError(f"unknown status {status!r}")
    if (limit or 0) < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    chosen = batches.where(F.col("status") == status) if status is not None else batches
    order = [F.col(sort_by).desc() if descending else F.col(sort_by).asc(), F.col("id").asc()]
    page = chosen.orderBy(*order).offset(offset)
    own = documents
    if limit is not None:
        # only the page's batches are counted: its ids, as many as the limit, filter the documents before they are shuffled
        page = page.limit(limit)
        ids = page.select(F.col("id").alias("batch_id"))
        own = documents.join(F.broadcast(ids) if limit <= MOST_BROADCAST else ids, "batch_id", "left_semi")
    counts = own.groupBy("batch_id").agg(F.count("*").alias("total_documents"))
    rows = page.join(counts, page.id == counts.batch_id, "left").drop("batch_id").withColumn("total_documents", F.coalesce("total_documents", F.lit(0)))
    return rows.orderBy(*order), batches.agg(F.count("*").alias("total"))


def documents_per_batch(batches: DataFrame, documents: DataFrame) -> DataFrame:
    counts = documents.groupBy("batch_id").agg(F.count("*").alias("n"))
    return batches.select("id").join(counts, F.col("id") == F.col("batch_id"), "left").select(F.col("id").alias("batch_id"), F.coalesce("n", F.lit(0)).alias("total_documents"))


def status_counts(documents: DataFrame) -> DataFrame:
    """Counts by batch and status; pending, processed and failed have columns, others a map."""
    known = ("pending", "processed", "failed")
    base = documents.groupBy("batch_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in known), F.count_if(~F.col("status").isin(*known)).alias("other"))
    return base


def histograms(documents: DataFrame, dimensions: tuple[str, ...] = ("status", "source_type", "route", "tipo_documento", "error_category", "quality_traffic_light"), keep_null: tuple[str, ...] = ("status", "source_type", "route", "tipo_documento")) -> DataFrame:
    """``batch_id, metric, key, n`` for each value of each dimension, in one pass; null is a value where ``keep_null`` says so."""
    pairs = F.array(*(F.struct(F.lit(d).alias("metric"), F.col(d).cast("string").alias("key")) for d in dimensions))
    rows = documents.select("batch_id", F.explode(pairs).alias("p")).select("batch_id", "p.metric", "p.key")
    return rows.where(F.col("key").isNotNull() | F.col("metric").isin(*keep_null)).groupBy("batch_id", "metric", "key").agg(F.count("*").alias("n"))


def fused(documents: DataFrame) -> DataFrame:
    """All single numbers of a batch's metrics in one aggregate."""
    whole = F.lit(True)
    for f in FIELDS:
        whole = whole & F.col(f).isNotNull()
    return documents.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        *(F.count(f).alias(f"with_{f}") for f in FIELDS),
        F.count_if(whole).alias("with_all"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("average_quality"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_bytes"),
    )


def percentage(part: Column, total: Column) -> Column:
    """Two decimals, half to even; 0 without a total."""
    return F.when(total > 0, F.bround(part / total * 100, 2)).otherwise(F.lit(0.0))


def metrics(documents: DataFrame) -> DataFrame:
    """The metrics report in long form: ``batch_id, metric, key, n, pct``; shares are of all documents of the batch."""
    totals = fused(documents)
    wanted = [("fields", f, f"with_{f}") for f in FIELDS] + [("fields", "all", "with_all")]
    singles = totals.select("batch_id", "total", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), F.col(c).alias("n")) for m, k, c in wanted))).alias("p"))
    rows = singles.select("batch_id", "p.metric", "p.key", "p.n", "total").unionByName(histograms(documents).join(totals.select("batch_id", "total"), "batch_id"))
    return rows.select("batch_id", "metric", "key", "n", percentage(F.col("n"), F.col("total")).alias("pct"))


def kpis(reports: DataFrame) -> DataFrame:
    """The five figures above a report, with what stands in for those that are missing.

    ``reports`` has ``batch_id, total_documents, processing_seconds, average_quality, total_size_mb, processed, processed_pct``. Numbers
    that are null are 0; a share that is null is counted anew from ``processed`` of all, 0 without documents.
    """
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))
    total = number("total_documents", "long")
    return reports.select(
        "batch_id",
        number("processing_seconds", "double").alias("processing_seconds"),
        total.alias("total_documents"),
        number("average_quality", "double").alias("avg_quality"),
        F.coalesce(F.col("processed_pct").cast("double"), percentage(number("processed", "long"), total)).alias("success_rate"),
        number("total_size_mb", "double").alias("total_size_mb"),
    )


def detail(documents: DataFrame) -> DataFrame:
    """A row for each batch with its documents nested in order of id, confidences as a map."""
    fields = [c for c in documents.columns if c not in ("batch_id", "field_confidence_json")]
    doc = F.struct(*fields, F.from_json("field_confidence_json", "map<string,double>").alias("field_confidence")) if "field_confidence_json" in documents.columns else F.struct(*fields)
    return documents.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("o"), doc.alias("d")))).alias("x")).select("batch_id", F.col("x.d").alias("documents"))


def export_rows(batches: DataFrame, documents: DataFrame, source_paths: DataFrame | None = None) -> DataFrame:
    """The export's twenty columns, with a link where ``source_paths (batch_key, document_id, source_path, ordinal)`` knows one; the last of several counts."""
    rows = documents.join(batches.select(F.col("id").alias("batch_id"), "batch_key"), "batch_id").withColumn("document_id", F.col("id"))
    if source_paths is None:
        rows = rows.withColumn("source_path", F.lit(None).cast("string"))
    else:
        last = source_paths.groupBy("batch_key", T.whole_id(F.col("document_id")).alias("document_id")).agg(F.max_by("source_path", "ordinal").alias("source_path"))
        rows = rows.join(last, ["batch_key", "document_id"], "left")
    made = {
        "link": T.hyperlink(F.col("source_path")),
        "file_size_bytes": F.col("file_size"),
        "file_size_kb": F.bround(F.coalesce("file_size", F.lit(0)) / 1024, 2),
    }
    return rows.withColumns(made).select(*V.EXPORT_COLUMNS)


def processing_route(route: Column) -> Column:
    names = F.create_map(*(F.lit(x) for x in ("digital_pdf", "digital", "ocr_image", "ocr", "structured_document", "structured")))
    return F.coalesce(F.try_element_at(names, route), route)


def apply_results(documents: DataFrame, results: DataFrame, as_of_year: int, score: bool = True) -> DataFrame:
    """Documents with the results of processing: failed ones lose their fields, others are scored unless it is a retry."""
    failed = F.col("r.status") == "failed"
    new = {f: F.when(failed, F.lit(None)).otherwise(F.col(f"r.{f}")) for f in FIELDS}
    rows = documents.alias("d").join(results.alias("r"), "id", "left")
    hit = F.col("r.status").isNotNull()
    out = {**{f: F.when(hit, v).otherwise(F.col(f"d.{f}")) for f, v in new.items()}, "status": F.coalesce("r.status", "d.status"), "error_category": F.when(hit, F.col("r.error_category")).otherwise(F.col("d.error_category"))}
    keep = [F.col(f"d.{c}").alias(c) for c in documents.columns if c not in (*out, "id", "quality_score", "quality_traffic_light", "quality_reasons", "field_confidence_json")]
    old = [F.col(f"d.{c}").alias(c) for c in ("quality_score", "quality_traffic_light", "quality_reasons", "field_confidence_json")]
    merged = rows.select("id", *keep, *(v.alias(k) for k, v in out.items()), *old, (hit & ~failed).alias("__scored"))
    if not score:
        return merged.drop("__scored").select(*documents.columns)
    q = quality.scored(*(F.col(f) for f in FIELDS), as_of_year)
    reasons, confidence = quality.stored(F.col("__q"))
    fresh = {"quality_score": F.col("__q.score"), "quality_traffic_light": F.col("__q.traffic_light"), "quality_reasons": reasons, "field_confidence_json": confidence}
    scored = merged.withColumn("__q", q)
    return scored.withColumns({k: F.when(F.col("__scored"), v).otherwise(F.col(k)) for k, v in fresh.items()}).select(*documents.columns)


def log_rows(results: DataFrame, action: str, at: str, success: str = "success") -> DataFrame:
    """Audit rows of a processing run; details as JSON."""
    return results.select(
        F.col("id").alias("document_id"),
        F.lit(action).alias("action"),
        F.when(F.col("status") == "failed", "failed").otherwise(success).alias("status"),
        "error_category",
        F.to_json(F.struct(*FIELDS)).alias("details_json"),
        F.lit(at).cast("timestamp").alias("created_at"),
    )


def failed_documents(documents: DataFrame, batch_id: int) -> DataFrame:
    return documents.where((F.col("batch_id") == batch_id) & (F.col("status") == "failed"))


def delete_batches(keys: DataFrame, batches: DataFrame, documents: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the batches of ``keys (batch_key)``, their documents and these documents' logs."""
    gone = batches.join(keys, "batch_key", "left_semi").select(F.col("id").alias("batch_id"))
    gone_documents = documents.join(gone, "batch_id", "left_semi").select(F.col("id").alias("document_id"))
    return batches.join(keys, "batch_key", "left_anti"), documents.join(gone, "batch_id", "left_anti"), logs.join(gone_documents, "document_id", "left_anti")


def duplicate_of(documents: DataFrame) -> DataFrame:
    """``id, duplicate_of``: the first other document with the same file hash by id, null for none."""
    # two smallest ids of each hash decide for all; partial aggregates keep popular hashes small
    least = documents.where("file_hash IS NOT NULL").groupBy("file_hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    several = least.where("first < last")
    second = documents.join(several, "file_hash").where("id > first").groupBy("file_hash").agg(F.min("id").alias("second"))
    pairs = several.join(second, "file_hash").select("file_hash", "first", "second")
    other = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return documents.join(pairs, "file_hash", "left").select("id", other.alias("duplicate_of"))


def upload_reasons(files: DataFrame) -> DataFrame:
    """``files (name, size)`` with source type, why one is rejected, and whether it is stored; oversize ones are both."""
    base = F.regexp_extract(F.coalesce("name", F.lit("")), r"([^/\\]*)$", 1)
    kind = T.extension(base)
    reason = F.when(base == "", "missing filename").when(~kind.isin(*V.SUPPORTED_TYPES), "unsupported extension").when(F.col("size") > V.MAX_UPLOAD_BYTES, "file too large")
    return files.withColumns({"base_name": base, "source_type": kind, "reason": reason}).withColumn("accepted", F.col("reason").isNull() | (F.col("reason") == "file too large"))


def running_minimum(estimates: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """An estimate that never grows: the least so far."""
    return estimates.withColumn("stable", F.min(value).over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
