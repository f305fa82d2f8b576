import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.llm import common
from folioflow.llm import op3_simhash as op


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É À b c d", "a b a b a b a b", "x\x1cy z\x85w \xa0 v", "word " * 30000, "The quick brown fox jumps over the lazy dog"])
def test_fingerprint(text):
    assert op.simhash(text) == plain(text)


def clustered(rng, n, spread):
    out = set()
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 120))
def test_forests(seed, n):
    numbers = clustered(random.Random(seed), n, 6)
    want = groups([(a, b) for a in numbers for b in numbers if a < b and (a ^ b).bit_count() <= 3], numbers)
    for links in (op.forest_small(numbers), op.forest_large(np.array(numbers, np.uint64))):
        assert all((a ^ b).bit_count() <= 3 for a, b in links) and len(links) < max(2, n)
        assert groups(links, numbers) == want


def test_links(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 16)  # many shards are cut
    numbers = clustered(random.Random(5), 700, 5)
    signed = np.array(numbers, np.uint64).view(np.int64).tolist()
    links = op.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = groups([(a, b) for a, x in zip(signed, numbers) for b, y in zip(signed, numbers) if a < b and (x ^ y).bit_count() <= 3], signed)
    assert groups([(r.a, r.b) for r in links], signed) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)] + [(400, x) for x in range(401, 500)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == want


def test_table(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "Only", "only"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = list(base)
            other[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(other).upper())
    ids = rng.sample(range(1000), len(texts))
    rows = [Row(doc_id=i, text=t, fp="clash", key=1, component="x") for i, t in zip(ids, texts)]
    rows += rows[:3]
    got = op.near_duplicates(spark.createDataFrame(rows)).collect()
    fp = {i: plain(t) for i, t in zip(ids, texts)}
    want = groups([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    for r in got:
        assert r.fp % 2**64 == fp[r.doc_id] and r.component_id == want[r.doc_id]


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_keys_join(spark):
    facts = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "x long, k long")
    dims = facts.groupBy("k").agg(F.min("x").alias("first"), F.count("*").alias("n"))
    got = common.join_by_key(facts, dims, "k", 300).collect()
    assert len(got) == 300 and all(r.first == (1 if r.k == 0 and r.x else r.k) or (r.k == 0 and r.first == 0) for r in got)
