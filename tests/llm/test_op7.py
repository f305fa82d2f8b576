import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from folioflow.llm import op7_packing as op

PATH = P.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World!", "it's  we've\n\n12345 \t x", "É à ÜBER 漢字 👍🏽", "a ★ b ★", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "\x0b", "word " * 9000, "Σίσυφος ΣΣ", "é ́x   y"]


def check(pieces, lengths, window):
    """Every token once, offsets gapless from zero, sequences no longer than the window and little padded."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        assert n > 0
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(by_doc[d]):
            assert s == at
            at += m
        assert at == n
    for rows in by_seq.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= window and at & (at - 1) == 0  # full or a power of two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=40), min_size=1, max_size=25))
def test_shards(docs):
    docs = [np.array(x, np.uint32) for x in docs]
    check(op.pack_shard(docs, 16), list(map(len, docs)), 16)


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * k, 1000 * k + 50, 30).astype(np.uint32) for k in range(4) for _ in range(4)]
    order = rng.permutation(16)
    seqs = defaultdict(set)
    for d, _, _, q, _ in op.pack_shard([topics[i] for i in order], 128):
        seqs[q].add(order[d] // 4)
    assert sum(len(x) for x in seqs.values()) <= 8


def bm25(counts, df, n, mean, lengths, seed):
    score = {}
    for d, c in enumerate(counts):
        for t in c.keys() & counts[seed].keys():
            idf = np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
            score[d] = score.get(d, 0) + idf * c[t] * (op.K1 + 1) / (c[t] + op.K1 * (1 - op.B + op.B * lengths[d] / mean))
    return score


@pytest.mark.parametrize("dense", [1, 4, 16, 1000])
def test_neighbours_against_brute_force(monkeypatch, dense):
    """All terms of a seed count, with statistics of a larger corpus, however terms are stored."""
    monkeypatch.setattr(op, "DENSE", dense)
    rng = np.random.default_rng(5)
    corpus = [np.minimum(rng.geometric(0.01, rng.integers(20, 90)), 399).astype("<u2") for _ in range(120)]
    docs, statistics = corpus[:50], op.Statistics.of(corpus)
    df = defaultdict(int)
    for d in corpus:
        for t in set(d.tolist()):
            df[t] += 1
    counts = [dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)))) for d in docs]
    index = op.InvertedIndex(docs, statistics)
    for seed in range(10):
        score = bm25(counts, df, len(corpus), sum(map(len, corpus)) / len(corpus), [len(d) for d in docs], seed)
        unused = rng.random(len(docs)) < 0.8
        got = index.neighbours(seed, unused).tolist()
        alone = {d for d in score if all(sum(t in c for c in counts) == 1 for t in counts[d].keys() & counts[seed].keys())}  # the seed itself
        want = {d for d in score if unused[d]} - alone - {seed}
        assert set(got) - {seed} == want
        assert np.allclose([score[d] for d in got if d != seed], sorted((score[d] for d in want), reverse=True))


@pytest.mark.parametrize("dense", [1, 16, 1000])
def test_used_documents_are_forgotten(monkeypatch, dense):
    """What is left has the same neighbours in the same order, used seeds too, and no used document costs a score."""
    monkeypatch.setattr(op, "DENSE", dense)
    rng = np.random.default_rng(7)
    docs = [np.minimum(rng.geometric(0.02, rng.integers(1, 60)), 199).astype("<u2") for _ in range(80)]
    whole, less = (op.InvertedIndex(docs, op.Statistics.of(docs)) for _ in range(2))
    unused = np.ones(80, bool)
    for share in (0.7, 0.7, 0.1, 0):
        unused &= rng.random(80) < share
        less.keep(unused)
        assert len(less.scores(0)) == unused.sum()
        assert all(less.neighbours(d, unused).tolist() == whole.neighbours(d, unused).tolist() for d in range(80))


def test_statistics_cover_all_documents(spark):
    rows = [(i, f"word{i % 7} and {'x ' * (i % 5)} common") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = op.encoded(docs, PATH, 2)
    got, plain = op.corpus_statistics(found, op.id_type(PATH)), Tokenizer.from_file(PATH)
    want = op.Statistics.of([np.array([*plain.encode(t, add_special_tokens=False).ids, 2]) for _, t in rows])
    assert (got.n, got.mean) == (want.n, want.mean) and got.df.tolist() == want.df.tolist()


def test_documents_of_a_rare_term_meet(spark):
    """Copies of ten texts, scattered over the input, share windows."""
    rng = np.random.default_rng(3)
    kinds = [" ".join(f"{chr(97 + k)}{rng.integers(10**6)}" for _ in range(150)) for k in range(10)]
    docs = spark.createDataFrame([(i, kinds[i % 10]) for i in range(200)], "doc_id long, text string").repartition(4)
    by = defaultdict(list)
    for r in op.pack_documents(docs, PATH, shard_tokens=1 << 15).collect():
        by[r.sequence_id].append(r.doc_id % 10)
    assert sum(max(map(x.count, set(x))) / len(x) for x in by.values()) / len(by) > 0.6


def test_words():
    plain = Tokenizer.from_file(PATH)
    for small in (op.WordEncoder(PATH), op.WordEncoder(PATH, remembered=2)):
        for _ in range(2):
            for text, raw in zip(TEXTS, small.encode(TEXTS)):
                assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


ODD = [" ", "\n", "\t", "a", "B", "H", "ß", "É", "Ñ", "é", "×", "÷", "Σ", "İ", "\u212a", "\u0301", "\u0331", "'", "'s", "'LL", ",", ".", "|", "<", ">", "(", "-", "7", "½", "—", "漢", "👍🏽", "♥", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\x0b"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=12).map("".join), max_size=5))
def test_odd_words(texts):
    plain, words = Tokenizer.from_file(PATH), op.encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 16)
    texts = ["One, two  three.\nFour! " * 9, "", "x" * 50 + " y", "<|endoftext|> " * 5, " " * 40, None, "é, É. " * 8]
    plain = Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in op.WordEncoder(PATH).encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_learnt_once():
    """Whatever its capitals and the punctuation after it, a word goes through the tokenizer once and takes one place in memory."""
    words = op.WordEncoder(PATH)
    before = set(words.known)
    ends = ("", ",", ".", "!", "?", ";", ").")
    words.encode([f"{w}{p}" for w in ("zyxwab", "Zyxwab", "ZYXWAB", "éñzy", "Éñzy") for p in ends])
    assert 2 <= len(words.known.keys() - before) <= 2 + len(ends)


def test_table(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [Row(doc_id=i, text=t, start="clash") for i, t in enumerate(TEXTS)]
    got = op.pack_documents(spark.createDataFrame(rows).repartition(3), PATH).collect()
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(TEXTS)}
    check([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], [len(ids[i]) for i in range(len(TEXTS))], 4096)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_repeated_rows_and_empty_table(spark):
    one = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string").coalesce(1)
    got = op.pack_documents(one, PATH).collect()
    assert sum(r.length for r in got) == 12
    assert op.pack_documents(one.where("false"), PATH).collect() == []
