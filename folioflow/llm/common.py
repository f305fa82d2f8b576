"""What the operators of this subpackage share: tables, written intermediate results, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and that are stripped from the ends of lines.
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    It is set here only where the session leaves it unset, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        _remove_at_exit(spark, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session or its JVM may be gone already
            pass

    atexit.register(remove)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library (glibc) would hold it for later."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_key():
    """A second key beside ``doc_id``, so that rows that share an id but not a text stay apart; null and empty differ."""
    return F.coalesce(F.xxhash64(F.lit(11), F.col("text")), F.lit(0))


#: A key counts as hot if more than one row in so many has it, so fewer keys than this are hot.
HOT_SHARE = 1024


def join_by_key(facts: DataFrame, dims: DataFrame, key: str, total: int) -> DataFrame:
    """``facts`` inner-joined with ``dims``, one row a key, whose column ``n`` says how many facts have the key.

    ``total`` is the number of facts. The rows of hot keys are joined where they are, by a broadcast of
    fewer than ``HOT_SHARE`` rows whatever the input; only the others are shuffled. ``n`` is dropped.
    """
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(dims.where(is_hot).drop("n"))
    rest = facts.join(hot.select(key), key, "left_anti").join(dims.where(~is_hot).drop("n"), key)
    joined = facts.join(hot, key)
    return joined.unionByName(rest.select(*joined.columns))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)`` by alternating large-star and small-star steps.

    Returns ``(node, component)`` for every node that occurs in an edge with two different ends;
    the component is the smallest node in it. No step gathers a component in one task: each keeps a
    minimum per node, which is aggregated before the shuffle, so a hub of any degree costs its edges
    and no more. Both steps together need a number of rounds that grows as the squared logarithm of
    the nodes at most. The edges of a round are written to the shared folder.
    """
    both = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b")
    pairs = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        directed = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = directed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = directed.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours are tied to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a")
        pairs = written(
            star.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
