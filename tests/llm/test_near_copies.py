import random

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import near_copies as op
from folioflow.llm import op3_simhash
from tests.llm.test_op3 import groups


def brute(texts):
    sets = {i: op.shingles(t) for i, t in texts.items()}
    return groups([(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or sets[a] and op.similar(sets[a], sets[b]))], sets)


def copies(seed, sizes, swaps, per):
    rng = random.Random(seed)
    texts = []
    for n in sizes:
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(per):
            own = list(words)
            for at in rng.sample(range(n), max(1, int(n * swaps))):
                own[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_the_stage_drops_copies_at_80_to_95_percent(spark):
    rng, texts = random.Random(1), {}
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[2 * k] = " ".join(words)
        at = rng.randrange(300)
        words[at : at + rng.randrange(10, 50)] = []
        texts[2 * k + 1] = " ".join(words)
    sets = {i: op.shingles(t) for i, t in texts.items()}
    near = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(60)]
    assert sum(0.8 <= j <= 0.95 for j in near) > 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    want = brute(texts)
    assert kept == {i for i in texts if want[i] == i}


@pytest.mark.parametrize("swaps, per", [(0.01, 60), (0.02, 40), (0.05, 2)])
def test_groups(spark, swaps, per):
    texts = copies(7, [4, 6, 11, 40, 200, 400], swaps, per) | {9000: "", 9001: None, 9002: " \n", 9003: "One two", 9004: "one TWO", 9005: "two one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op.near_copies(docs).collect()}
    assert got == brute(texts)


def test_empty_table(spark):
    assert op.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("width", [op.FIRST, op.SKETCH])
def test_screen_keeps_similar_pairs(width):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 500))
        a = rng.integers(0, 2**32 - 1, n).astype(np.uint32)
        both = -(-8 * n // 9)  # a Jaccard similarity of 0.8 if as many differ in each
        b = np.concatenate([a[:both], rng.integers(0, 2**32 - 1, n - both).astype(np.uint32)])
        sketches = np.full((2, width), op.PAD, np.uint32)
        for row, x in zip(sketches, (a, b)):
            row[: min(n, width)] = np.sort(x)[:width]
        assert op.screened(sketches, np.array([n, n]), 0, np.array([1])).tolist() == [1]


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    alone = [" ".join(f"{p}{k}" for k in range(40)) for p in "abcdefgh"]
    rows = [(3, "one two three four five six seven")]
    for i, t in enumerate(alone):  # a copy of document 3 and a text of its own under each id; the last also twice
        rows += [(10 + i, rows[0][1]), (10 + i, t)]
    rows += [rows[-1], (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())
    assert got == sorted([(0, ""), (0, rows[0][1]), rows[0], *((10 + i, t) for i, t in enumerate(alone))])


def hashes(text):
    return op.least_hashes(text)[4]


@pytest.mark.parametrize("sizes", [[0], [], [1, 0, 2, 255, 256, 0, 3], [70_000, 5], [40] * 200])
def test_fingerprints_are_majorities_of_bits(sizes):
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 2**64 - 1, n, dtype=np.uint64) for n in sizes]
    got = op.simhashes(texts)
    assert got.shape == (len(sizes), op.BITS // 64)
    for own, row in zip(texts, got):
        bits = (op.spread(own)[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=1, dtype=np.int64)
        assert row.tolist() == [sum(1 << b for b in range(64) if 2 * c[b] > len(own)) for c in bits.tolist()]


def test_fingerprint_begins_with_that_of_64_bits():
    text = " ".join(f"w{i}" for i in range(200))
    assert op.simhashes([hashes(text)])[0, 0] == op3_simhash.simhash(text, op.WORDS)
    assert not op.simhashes([hashes(None), hashes(" \n")]).any()


def test_pairs_at_80_percent_lie_within_the_radius():
    rng = np.random.default_rng(9)
    for common, a, b in [(4, 1, 0), (12, 3, 0), (20, 3, 2), (8, 1, 1), (400, 50, 50), (80, 20, 0)] * 50:
        own = rng.integers(0, 2**64 - 1, common + a + b, dtype=np.uint64)
        x, y = op.simhashes([own[: common + a], np.concatenate([own[:common], own[common + a :]])])
        assert op.apart(x[None], y)[0] <= op.RADIUS
    x, y = op.simhashes([rng.integers(0, 2**64 - 1, 300, dtype=np.uint64) for _ in range(2)])
    assert op.apart(x[None], y)[0] > op.RADIUS


def test_walk_finds_all_within_the_radius():
    rng = np.random.default_rng(10)
    centres = rng.integers(0, 2**64 - 1, (12, 16), dtype=np.uint64)
    prints = centres[rng.integers(0, 12, 150)]
    for row in prints:
        for at in rng.integers(0, 1024, rng.integers(0, 300)).tolist():
            row[at // 64] ^= np.uint64(1 << at % 64)
    prints[7] = prints[3]
    queries = np.arange(0, 150, 2)
    got = [(node, q) for node, near in op.walk(prints, queries) for q in near.tolist()]
    far = np.array([op.apart(prints, p) for p in prints])
    assert len(got) == len(set(got)) and set(got) == {(a, q) for a in range(150) for q in queries.tolist() if far[a, q] <= op.RADIUS}
    assert list(op.walk(prints[:0], queries[:0])) == []


@pytest.mark.parametrize("hubs, k", [(1, 2), (1, op.FEW), (1, op.FEW + 30), (16, op.FEW + 30), (None, op.FEW + 30)])
def test_pairs_of_a_shard_come_through_fingerprints(hubs, k):
    """Sketches alike are no candidates if the fingerprints are far apart; all others that have to meet are."""
    rng = np.random.default_rng(11)
    sizes, sketches = np.full(k, op.FIRST), np.tile(np.arange(op.FIRST, dtype=np.uint32), (k, 1))
    prints = rng.integers(0, 2**64 - 1, (2, 16), dtype=np.uint64)[np.arange(k) % 2]
    component = np.arange(k) if hubs == 1 else np.arange(k) // 5
    got = {(min(i, j), max(i, j)) for i, others in op.bucket_pairs(sizes, sketches, prints, component, hubs, 0) for j in others.tolist()}
    alike = {(i, j) for i in range(k) for j in range(i + 1, k) if i % 2 == j % 2 and component[i] != component[j]}
    met = range(hubs if component[1] else 5) if hubs and k > op.FEW else range(k)
    assert got == {(i, j) for i, j in alike if i in met or j in met}
