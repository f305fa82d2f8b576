import random
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Row

from folioflow.llm import op10_toxicity as op

INSULTS = ["idiot", "moron", "worthless", "pathetic", "blockhead"]
SYLLABLES = ["ba", "ke", "lo", "mi", "su", "ta", "re", "no", "vi", "du", "sha", "ent"]


def brute_kernel(a, b):
    def weights(term):
        codes, out = op._codes(term), {}
        for at in combinations(range(len(codes)), 3):
            if at[2] - at[0] < op.SPAN:
                key = tuple(codes[i] for i in at)
                out[key] = out.get(key, 0) + op.DECAY ** (at[2] - at[0] + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel():
    terms = ["idiot", "idxiot", "iidiot", "abc", "a", "ññ1", "aaaaaaaa", "loweischaft"]
    got = op._kernel(terms, terms)
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            assert got[i, j] == pytest.approx(brute_kernel(a, b) if brute_kernel(a, b) else 0)
    assert got[0, 1] > 0.5 > got[0, 7]


def test_folding_is_the_nystrom_machine():
    """Folded weights decide as the sum over landmarks does."""
    weights, bias = op.fit(INSULTS, ["bakelo", "misuta", "reno", "vidu"] * 3, ["shaent"])
    machine = op.Machine(weights, bias, 1.0, 0.0)
    assert (machine.decide(INSULTS) > 0).all() and (machine.decide(["bakelo", "reno", "kelomi"]) < 0).all()


def random_terms(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 12))) for _ in range(n)]


def test_training_holds_few_rows_at_once():
    positive, plain, hard = random_terms(100, 1), random_terms(op.PLAIN * 2, 2), random_terms(op.PLAIN, 3)
    tracemalloc.start()
    try:
        op.fit(positive, plain, hard)
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()


def test_rows_held_do_not_change_the_machine(monkeypatch):
    terms = random_terms(20, 4), random_terms(300, 5), random_terms(100, 6)
    weights, bias = op.fit(*terms)
    monkeypatch.setattr(op, "ROWS", 7)
    monkeypatch.setattr(op, "BLOCK", 13)
    again, other = op.fit(*terms)
    assert again == pytest.approx(weights, abs=1e-9) and other == pytest.approx(bias, abs=1e-9)


def test_long_terms_empty_and_spelt_words():
    weights, bias = op.fit(INSULTS, ["bakelo", "misuta", "reno", "vidu"], [])
    machine = op.Machine(weights, bias, 4.0, 0.0)
    assert machine.worst([None, "", " \n "]) == [bias] * 3
    assert len(machine.worst(["x" * 50_000 + " " + "ba" * 10_000])) == 1
    plain, gapped, marked = machine.worst(["you idiot", "you i d i o t", "you i.d.i.o.t"])
    assert plain == pytest.approx(gapped) == pytest.approx(marked)
    assert op.spelt("a b c d") == ["abcd"] and op.spelt("no such run a b") == []


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        sentences = [" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(8)) for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                k = rng.randrange(5)
                sentences[k] += " " + rng.choice(INSULTS)
        rows.append((i, ". ".join(sentences).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, toxic="clash", score=1, term="x") for i, t, _ in rows])
    extra = [(2000, None), (2001, ""), (2002, rows[0][1]), (2002, rows[0][1]), (2003, "Ba ke lo you idxiot su ta."), (2004, "word " * 40_000)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (7777, 1)], "doc_id long, toxic int")
    return {i: y for i, _, y in rows}, op.judge_toxicity(docs, labels).collect()


def test_held_out_accuracy(judged):
    from zlib import crc32

    truth, got = judged
    assert len(got) == 906
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)


def test_special_documents(judged):
    got = {r.doc_id: r for r in judged[1]}
    assert [got[i].predicted for i in (2000, 2001, 2002, 2004)] == [0, 0, got[0].predicted, 0]
    assert got[2003].predicted == 1  # an inserted character


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a = op.train(docs, labels)
    b = op.train(docs, labels.where(~op.in_fold("doc_id")))
    assert np.allclose(a.weights, b.weights) and a.middle == b.middle


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in op.judge_toxicity(docs, none).collect()] == [0]
    assert op.judge_toxicity(docs.where("false"), none).collect() == []
