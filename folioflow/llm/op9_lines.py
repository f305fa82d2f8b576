"""Line dedup without moving text: hashes are dealt by range, documents get back keep bitmaps.

Every line's key is hashed to 128 bits, and only hash, document and position are shuffled. Keys that
hold more than a 1024th of all lines are settled first: a partial aggregate finds their first
document, and that list (1023 rows at most, whatever the input) is broadcast. All other hashes are
range-partitioned and sorted by document and position within each hash, so a running window streams
each key's first occurrence, and no key can fill a task. What is dropped comes back as one
run-length encoded bitmap a document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_CODE_POINTS = 10
#: A key is hot if more than one in so many lines has it; so fewer keys than this can be hot.
HOT_SHARE = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, tk, pos, h1, h2`` of each line whose key is long enough; rows without an id take no part, whatever path a key goes."""
    key = F.translate(F.btrim("line", F.lit(common.BLANK)), UPPER, LOWER)
    return (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", common.text_key().alias("tk"), F.posexplode(_lines()).alias("pos", "line"))
        .select("doc_id", "tk", "pos", key.alias("key"))
        .where(F.char_length("key") >= MIN_CODE_POINTS)
        .select("doc_id", "tk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """The lines to drop, for documents that have any: ``doc_id, tk, n_dropped, runs``.

    ``runs`` is the keep bitmap, run-length encoded: first and last position of each run of zeros,
    in order; all other lines are kept.
    """
    hashes = common.written(line_hashes(docs), "lines")
    total = hashes.count()
    per_key = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    hot = per_key.where(F.col("n") * HOT_SHARE > total).select("h1", "h2", "first")
    hot = F.broadcast(common.written(hot, "hot"))
    settled = hashes.join(hot, ["h1", "h2"]).where("doc_id > first").select("doc_id", "tk", "pos")
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = (
        hashes.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange(parts, "h1", "h2")
        .withColumn("first", F.first("doc_id").over(ordered))
        .where("doc_id > first")
        .select("doc_id", "tk", "pos")
    )
    dropped = settled.unionByName(streamed).groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return dropped.select("doc_id", "tk", F.size("at").alias("n_dropped"), runs.alias("runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text`` (null only if the text is null and nothing is dropped), ``n_lines`` and ``n_dropped``."""
    marked = docs.withColumn("tk", common.text_key()).join(
        bitmaps.select(F.col("doc_id").alias("__d"), F.col("tk").alias("__t"), F.col("n_dropped").alias("__n"), F.col("runs").alias("__runs")),
        (F.col("doc_id") == F.col("__d")) & (F.col("tk") == F.col("__t")),
        "left",
    )
    lines = _lines()
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("__runs")),
            lambda i: F.slice(
                "__lines",
                F.coalesce(F.get("__runs", i - 1)["to"], F.lit(-1)) + 2,
                F.coalesce(F.get("__runs", i)["from"], F.size("__lines")) - F.coalesce(F.get("__runs", i - 1)["to"], F.lit(-1)) - 1,
            ),
        )
    )
    return (
        marked.withColumn("__lines", F.when(F.col("__n").isNotNull(), lines))
        .withColumn("kept_text", F.when(F.col("__n").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.col("__n"), F.lit(0)).cast("long"))
        .drop("tk", "__d", "__t", "__n", "__runs", "__lines")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Drop lines that an earlier document holds: ``doc_id, n_lines, n_dropped, kept_text``.

    A null or empty text is one empty line, never dropped; its ``kept_text`` stays as it was. Lines whose key has
    fewer than ten code points stay. All occurrences in the smallest ``doc_id`` stay, also when rows
    repeat; rows that share an id count as one document; rows without an id are no documents: they lose nothing and cost others
    nothing. A document that loses every line keeps an empty text. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    return apply_bitmaps(own, keep_bitmaps(own)).select("doc_id", "n_lines", "n_dropped", "kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
