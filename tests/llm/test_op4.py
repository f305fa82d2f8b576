import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from folioflow.llm import op4_suffixes as op

L = op.LENGTH


def brute(texts):
    seen = Counter()
    for t in texts:
        for i in range(len(t) - L + 1):
            seen[t[i : i + L]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - L + 1):
            if seen[t[i : i + L]] > 1:
                gone[i : i + L] = b"\1" * L
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = [[i, j] for i, j in zip((i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), (j + 1 for j in range(len(t)) if gone[j] and (j + 1 == len(t) or not gone[j + 1])))]
        out.append((len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "x", "日本", "epsilon-zeta"] + [f"w{rng.randrange(10**6)}" for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(k) for k in (20, 30, 35, 36, 37, 38, 40, 60, 200)]
    docs = ["", "a" * 199, "a" * 200, "b" * 201, "c" * 450, "ab" * 150, "short", text(300)]
    docs += [docs[-1], docs[-1] + "!", "?" + docs[-1][:-1]]
    while len(docs) < n:
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randrange(30)) for _ in range(rng.randrange(1, 7))]
        d = "".join(parts) if rng.random() < 0.3 else " ".join(parts)
        docs.append(d)
        if rng.random() < 0.4:  # a near copy: a few edits, also some that shift
            e = list(d)
            for _ in range(rng.randrange(1, 4)):
                if e:
                    k = rng.randrange(len(e))
                    e[k : k + rng.randrange(2)] = rng.choice(["", "z", "ß"])
            docs.append("".join(e))
    return docs


def test_cover():
    assert {(a - b) % op.MODULUS for a in op.COVER for b in op.COVER} == set(range(op.MODULUS))


@pytest.mark.parametrize("seed, block, piece", [(1, 1 << 20, 1 << 20), (2, 3000, 500), (3, 1, 1 << 20), (4, 20_000, 700), (5, 2000, 300)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, block, piece):
    """Texts in one block, in many, and cut into pieces."""
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "PIECE", piece)
    texts = corpus(seed)
    rows = [Row(doc_id=i, text=t, block="clash", bucket=1, kind=2, blob="x", n_bytes=-1) for i, t in enumerate(texts)]
    got = op.dedup_suffixes(spark.createDataFrame(rows).repartition(3), with_text=True, carry=("blob",)).collect()
    want = brute([t.encode() for t in texts])
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans) == want[r.doc_id] and r.blob == "x"
        raw = texts[r.doc_id].encode()
        cut = bytearray(raw)
        for a, b in reversed(r.spans):
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            del cut[a:b]
        assert r.kept_text == cut.decode()


def test_nulls_repeats_and_empty(spark):
    long = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(200))
    df = spark.createDataFrame([(1, None), (2, long), (2, long), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_text) for r in op.dedup_suffixes(df, with_text=True).select("doc_id", "n_bytes", "n_removed", "kept_text").collect() if r.kept_text is not None)
    assert got == [(2, len(long), len(long), ""), (2, len(long), len(long), ""), (3, 0, 0, "")]
    assert [r.kept_text for r in op.dedup_suffixes(df.where("doc_id = 1"), with_text=True).collect()] == [None]
    assert op.dedup_suffixes(df.where("false")).collect() == []


def test_very_long_document(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 1 << 16)
    rng = np.random.default_rng(0)
    body = "".join(map(chr, rng.integers(97, 123, 300_000)))
    df = spark.createDataFrame([(1, body), (2, body[1000:1300] + "tail")], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in op.dedup_suffixes(df).collect()} == {1: (300, 1), 2: (300, 1)}


@pytest.mark.parametrize("shift", [0, 1, 17, 30, 31, 199])
def test_pieces(monkeypatch, shift):
    """A text's cuts make no string repeated, and repeated strings at cuts are found, in one process."""
    monkeypatch.setattr(op, "PIECE", 400)
    rng = np.random.default_rng(shift)
    text = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    at = op.cut(4000)[3][0] - 100 - shift
    other = text[at : at + 230] + bytes(rng.integers(97, 123, 900, dtype=np.uint8)) + text[at + 60 : at + 290]

    def removed(texts):
        blocks = []
        for origin, t in enumerate(texts):
            for s, e in op.cut(len(t)):
                low = max(0, s - op.MODULUS)
                blocks.append((op.Bytes([t[low : min(len(t), e + op.MODULUS + L)]], (origin, low, s - low, e - low)), origin))

        def ask(sent, how):
            by, back = {}, [{} for _ in blocks]
            for k, own in enumerate(sent):
                for bucket, blob in own:
                    by.setdefault(bucket, []).append((k, blob))
            for bucket, own in by.items():
                for (k, _), bits in zip(own, how([x for _, x in own])):
                    if bits:
                        back[k][bucket] = bits
            return back

        rows = ask([[(k, x.tobytes()) for k, (x,) in op._by_bucket(keys, keys.astype("<u4"))] for _, keys, _ in (op.screen(b, 4) for b, _ in blocks)], op.answer_screen)
        candidate = [op.candidates(b, 4, r) for (b, _), r in zip(blocks, rows)]
        rows = ask([list(op.Names(b, op.sampled(b, c), k, 4).blobs()) if c.any() else [] for k, ((b, _), c) in enumerate(zip(blocks, candidate))], op.answer_names)
        parts = [op.split(b, c, k, 4, r) for k, ((b, _), c, r) in enumerate(zip(blocks, candidate, rows))]
        sent = []
        for (b, _), (_, open_) in zip(blocks, parts):
            _, key, h, g, _, _ = op.strings(b, open_, 4)
            sent.append([(k, x.tobytes() + y.tobytes()) for k, (x, y) in op._by_bucket(key, h, g)])
        rows = ask(sent, op.answer_strings)
        marks = [np.zeros(len(t), bool) for t in texts]
        for (b, origin), (repeated, open_), r in zip(blocks, parts, rows):
            found = np.flatnonzero(op.merged(b, repeated, open_, 4, r)) + b.start
            marks[origin][found] = True
        return [int(op.covered(len(t), m).sum()) for t, m in zip(texts, marks)]

    assert removed([text]) == [0]
    for texts in ([text, other], [text + other], [text, text], [other * 3]):
        assert removed(texts) == [w[1] for w in brute(texts)]
