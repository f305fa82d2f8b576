"""Embedding near-dedup through navigable small-world graphs.

Equal vectors of a label are one class. A label's classes are dealt into shards of a bounded size;
each shard gets a hierarchical navigable small-world graph over all its vectors, and every class of the
label queries every shard. A query's beam is widened until its worst member is below the threshold,
and the beam all queries start with is widened until an audit, brute force for a sample of queries, finds the
recall asked for; a beam as wide as the shard is a scan. Pairs found are verified in double precision. A
shard returns each query's number of links and a spanning forest of them, not the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.93
#: Classes of a shard, about.
SHARD = 6_000
#: Links of a node (twice as many on the ground level), beam while building, first beam of a query.
LINKS, BUILD_BEAM, BEAM = 12, 64, 64
#: A beam wider than this becomes a scan of the shard.
WIDEST = 512
#: Queries of a shard that are audited, and the share of their links that has to be found.
AUDITED, RECALL = 256, 0.98
#: Below the threshold by so much the graph's single-precision similarity still counts as a hit to verify.
SLACK = 1e-4


class SmallWorld:
    """A hierarchical navigable small-world graph over the rows of ``vectors`` (unit length), by cosine."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        self.level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.links: list[list[list[int]]] = [[[] for _ in range(self.level[i] + 1)] for i in range(n)]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)

    def _beam(self, q: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The best nodes found on a level, as (similarity, node), best first."""
        v, links = self.v, self.links
        seen = set(starts)
        near = [(float(s), i) for s, i in zip((v[starts] @ q).tolist(), starts)]
        todo = [(-s, i) for s, i in near]
        heapq.heapify(todo)
        heapq.heapify(near)
        while len(near) > width:
            heapq.heappop(near)
        while todo:
            s, c = heapq.heappop(todo)
            if len(near) >= width and -s < near[0][0]:
                break
            new = [x for x in links[c][level] if x not in seen]
            if not new:
                continue
            seen.update(new)
            for t, x in zip((v[new] @ q).tolist(), new):
                if len(near) < width:
                    heapq.heappush(near, (t, x))
                    heapq.heappush(todo, (-t, x))
                elif t > near[0][0]:
                    heapq.heapreplace(near, (t, x))
                    heapq.heappush(todo, (-t, x))
        return sorted(near, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes sorted by similarity those that are nearer to the query than to any taken before; then the best others."""
        nodes = [i for _, i in found[: 3 * most]]
        between = self.v[nodes] @ self.v[nodes].T
        taken: list[int] = []
        for k, (s, _) in enumerate(found[: len(nodes)]):
            if not taken or between[k, taken].max() < s:
                taken.append(k)
                if len(taken) == most:
                    break
        if len(taken) < most:
            rest = set(taken)
            taken += [k for k in range(len(nodes)) if k not in rest][: most - len(taken)]
        return [nodes[k] for k in taken]

    def _descend(self, q: np.ndarray, to: int) -> list[int]:
        starts = [self.entry]
        for level in range(len(self.links[self.entry]) - 1, to, -1):
            starts = [self._beam(q, starts, 1, level)[0][1]]
        return starts

    def _insert(self, i: int) -> None:
        q, top = self.v[i], len(self.links[self.entry]) - 1
        starts = self._descend(q, self.level[i])
        for level in range(min(self.level[i], top), -1, -1):
            found = self._beam(q, starts, BUILD_BEAM, level)
            self.links[i][level] = self._spread(found, LINKS)
            most = LINKS if level else 2 * LINKS
            for j in self.links[i][level]:
                own = self.links[j][level]
                own.append(i)
                if len(own) > most:
                    sims = (self.v[own] @ self.v[j]).tolist()
                    self.links[j][level] = self._spread(sorted(zip(sims, own), reverse=True), most)
            starts = [x for _, x in found]
        if self.level[i] > top:
            self.entry = i

    def within(self, q: np.ndarray, least: float, beam: int, own: int | None = None) -> np.ndarray:
        """Nodes found at a similarity of at least ``least``; a query that is a node also starts from itself."""
        q = np.asarray(q, np.float32)
        starts = list({*self._descend(q, 0), *([] if own is None else [own])})
        while beam <= WIDEST and beam < len(self.v):
            found = self._beam(q, starts, beam, 0)
            if len(found) < beam or found[-1][0] < least:
                return np.array([i for s, i in found if s >= least], np.int64)
            beam *= 2
        return np.flatnonzero(self.v @ q >= least)


class Shard:
    """A graph with what is needed to count and unite its links."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, threshold: float):
        self.ids, self.sizes, self.threshold = ids, sizes, threshold
        self.exact = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        self.graph = SmallWorld(self.exact)
        self.at = {int(x): i for i, x in enumerate(ids)}
        self.label = np.arange(len(ids))
        self.edges: list[tuple[int, int]] = []
        self.beam = BEAM

    def links_of(self, unit: np.ndarray, own: int | None) -> np.ndarray:
        near = self.graph.within(unit, self.threshold - SLACK, self.beam, own)
        hits = near[self.exact[near] @ unit >= self.threshold]
        return hits if own is None else hits[hits != own]

    def audit(self, queries: np.ndarray, own: list[int | None]) -> float:
        """Widen the first beam until the sampled queries' links are found; returns the recall."""
        true = self.exact @ queries.T >= self.threshold
        for k, i in enumerate(own):
            if i is not None:
                true[i, k] = False
        wanted = int(true.sum())
        while True:
            found = sum(len(self.links_of(q, i)) for q, i in zip(queries, own))
            if found >= RECALL * wanted or self.beam > WIDEST or self.beam >= len(self.ids):
                return found / wanted if wanted else 1.0
            self.beam *= 2

    def query(self, query_id: int, unit: np.ndarray) -> int:
        """The number of vectors linked to a query; links that unite two parts of the forest are kept as edges."""
        hits = self.links_of(unit, self.at.get(query_id))
        if not len(hits):
            return 0
        first = hits[0]
        self.edges.append((query_id, int(self.ids[first])))
        other = hits[self.label[hits] != self.label[first]]
        while len(other):
            self.edges.append((int(self.ids[first]), int(self.ids[other[0]])))
            self.label[self.label == self.label[other[0]]] = self.label[first]
            other = other[self.label[other] != self.label[first]]
        return int(self.sizes[hits].sum())


SCHEMA = "a long, b long, links long"


def _search(threshold: float):
    """Rows (group, shard, role, id, size, vector), a shard's own (role 0) before its queries (role 1), to links counted and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, shard, audited = None, [], None, False

        def edges() -> pa.RecordBatch:
            at = np.array(shard.edges, np.int64).reshape(-1, 2)
            shard.edges = []
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy()), pa.nulls(len(at), pa.int64())], ["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, part, role, ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            flat = batch.column(5)
            turns = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)]):
                vectors = flat.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(e - s, -1)
                if (group[s], part[s]) != key:
                    key, members, shard, audited = (group[s], part[s]), [], None, False
                if role[s] == 0:
                    members.append((ids[s:e], sizes[s:e], vectors))
                    continue
                if shard is None:
                    shard, members = Shard(*(np.concatenate(x) for x in zip(*members)), threshold), []
                units = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                if not audited:
                    step = max(1, (e - s) // AUDITED)
                    shard.audit(units[::step][:AUDITED], [shard.at.get(int(x)) for x in ids[s:e:step][:AUDITED]])
                    audited = True
                counts = np.array([shard.query(int(i), u) for i, u in zip(ids[s:e], units)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.nulls(e - s, pa.int64()), pa.array(counts)], ["a", "b", "links"])
                yield edges()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors (vec_id, embedding, label)``.

    Rows of one label whose cosine reaches ``threshold`` are linked; ``n_links`` counts the other rows
    linked to a row, ``component_id`` is the smallest ``vec_id`` reachable and ``kept`` says whether it is
    the row's own. Rows with a null label, a vector that is null, empty or all zero, or that holds null or
    non-finite components link with nothing; so do vectors of different lengths. Repeated rows are
    vectors of their own, linked to each other. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("usable", usable)
    alone = marked.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    good = marked.where("usable").select("vec_id", F.struct("label", "embedding").alias("key"))
    classes = good.groupBy("key").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("n"))
    # ids may repeat over different vectors; classes have their own numbers
    classes = common.written(classes.withColumn("class", F.xxhash64("key", "id")), "classes")
    group = F.xxhash64("key.label", F.size("key.embedding"))
    placed = classes.select("class", "n", F.col("key.embedding").alias("vector"), group.alias("group"))
    shards = placed.groupBy("group").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    placed = placed.join(shards, "group")
    own = placed.select("group", F.pmod("class", "shards").cast("int").alias("shard"), F.lit(0).alias("role"), "class", "n", "vector")
    queries = placed.select("group", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("role"), "class", "n", "vector")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(queries).repartition(parts, "group", "shard").sortWithinPartitions("group", "shard", "role", "class")
    found = common.written(dealt.mapInArrow(_search(threshold), SCHEMA), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    united = common.components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(united.select(F.col("node").alias("class"), "component"), "class", "left").join(counts, "class", "left")
    named = named.select("key", "id", "n", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = common.written(named, "named")
    groups = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    classes_named = common.join_by_key(named.withColumnRenamed("n", "copies"), groups, "component", named.count())
    dims = classes_named.select("key", "n_links", "component_id", F.col("copies").alias("n"))
    linked = common.join_by_key(good, dims, "key", good.count())
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (
  WITH RECURSIVE reach(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.v)
  SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, r.c AS component_id, vec_id = r.c AS kept
FROM embeddings JOIN r ON r.v = vec_id
"""
