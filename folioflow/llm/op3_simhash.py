"""SimHash near-dedup: fingerprints are linked through BK-trees over shards of them.

Fingerprints that differ in at most three of 64 bits agree in at least two of five blocks of bits, so
each is dealt to ten shards, one for each two blocks and their bits, and meets all its neighbours in
them. In each shard a BK-tree, whose children are keyed by their Hamming distance to the parent, is
searched along edges within the radius. Trees are dealt beside their queries, not broadcast: all
fingerprints together have no size bound. Shards over a bound are cut into chunks, and each two
chunks meet in a task. A shard returns a spanning forest of its links, at most one a fingerprint;
these are united by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS = 3
SEED = 42
WORDS = 3
#: Lowest bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a shard's chunk.
CHUNK = 2048
#: Up to so many fingerprints a tree is walked one query at a time.
FEW = 24


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_digest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < words:
        digests, n = xxh64_digest(joined, SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = [0, *(ends[: len(tokens) - words] + 1).tolist()]
        digests, n = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]), len(starts)
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for k in range(0, n, 8192):
        counts += np.unpackbits(rows[k : k + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of each row. Lower-casing takes A-Z alone, words end at ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


class BKTree:
    """A Burkhard-Keller tree over distinct 64-bit numbers under the Hamming distance."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if d == 0:
                return
            below = node[1].get(d)
            if below is None:
                node[1][d] = (x, {})
                return
            node = below

    def within(self, x: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            y, children = stack.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                found.append(y)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def forest_small(numbers: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``numbers``, as pairs."""
    tree, root, links = BKTree(), {x: x for x in numbers}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in numbers:
        for y in tree.within(x, radius):
            a, b = find(x), find(y)
            if a != b:
                root[a] = b
                links.append((x, y))
        tree.add(x)
    return links


def forest_large(numbers: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """The same for many numbers: a node's queries walk the tree together.

    The tree is built as it is walked: a node's subtree holds the numbers of its bucket, split by their
    distance to the node; the queries that go on to a child are those whose distance is within the radius of the edge.
    """
    label, links = np.arange(len(numbers)), []
    stack = [(np.arange(len(numbers)), np.arange(len(numbers)))]
    while stack:
        bucket, queries = stack.pop()
        node, rest = bucket[0], bucket[1:]
        far = np.bitwise_count(numbers[queries] ^ numbers[node]).astype(np.int16)
        hits = queries[far <= radius]
        other = hits[label[hits] != label[node]]
        while len(other):
            links.append((int(numbers[node]), int(numbers[other[0]])))
            label[label == label[other[0]]] = label[node]
            other = other[label[other] != label[node]]
        if len(rest):
            edges = np.bitwise_count(numbers[rest] ^ numbers[node]).astype(np.int16)
            for edge in np.unique(edges).tolist():
                on = queries[np.abs(far - edge) <= radius]
                if len(on):
                    stack.append((rest[edges == edge], on))
    return links


def shard_keys(fp: str):
    """The ten shards of a fingerprint: two blocks' bits, and above them which two."""
    keys = []
    for k, pair in enumerate(combinations(BLOCKS, 2)):
        (a, n), (b, m) = pair
        bits = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) + F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << m) - 1)), n)
        keys.append(bits + F.lit(k << 40))
    return F.array(*keys)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard; rows come sorted by shard, a shard perhaps over several batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(key, part, fp):
        turns = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate([[0], turns]), np.concatenate([turns, [len(key)]])
        out = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            numbers = fp[s:e]
            if e - s <= FEW:
                out += forest_small(numbers.tolist())
            else:
                out += forest_large(numbers)
        at = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held:
            key, part, fp = (np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((key, part, fp.view(np.uint64))))
        fp = fp.view(np.uint64)
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(key[:cut], part[:cut], fp[:cut])
        held = [(key[cut:], part[cut:], fp[cut:])]
    if held:
        yield links(*held[0])


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` whose components are those of all fingerprints ``fp`` within the radius of each other."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.explode(shard_keys("fp")).alias("key"))
    shared = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # shards of one need no visit; the join drops them
    placed = keyed.join(shared, "key")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.least(own, i) * chunks + F.greatest(own, i))
    dealt = placed.select("key", F.explode(F.when(F.col("n") > CHUNK, pair).otherwise(F.array(F.lit(0)))).alias("part"), "fp")
    return dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links between fingerprints that differ in
    at most three bits. Texts that are null or hold no word have fingerprint zero and link like any
    other. Repeated rows give repeated results; other columns are dropped; an empty table gives no rows.
    """
    rows = common.written(fingerprints(docs), "fingerprints")
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    groups = common.components(near_links(distinct.select("fp")))
    linked = distinct.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    sizes = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    kinds = linked.select("fp", "component", F.col("n").alias("rows"))
    named = common.join_by_key(kinds, sizes, "component", kinds.count()).select("fp", "component_id", F.col("rows").alias("n"))
    return common.join_by_key(rows, common.written(named, "named"), "fp", rows.count()).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
