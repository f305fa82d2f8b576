from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from folioflow.llm import op9_lines as op

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans(op.UPPER, op.LOWER)


def brute(rows):
    where = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            where[line.strip(BLANK).translate(LOW)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(BLANK).translate(LOW)) < 10 or min(where[k]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows):
    got = op.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in got)


LINE = st.sampled_from(["", "short", "0123456789", " 0123456789\t", "ABCDEFGHIJk", "abcdefghijK  ", "ÀÉÎÕÜàéîõü", "àéîõüàéîõü", "another long line", "\x0b a b c d e f \r"])
DOC = st.one_of(st.none(), st.lists(LINE, max_size=6).map("\n".join))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(DOC, max_size=12))
def test_against_brute_force(spark, docs):
    rows = list(enumerate(docs))
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(2, "a long line here\nx"), (2, "a long line here\nx"), (2, "other text of two\na long line here"), (1, None), (3, "A LONG LINE HERE\n\nother text of two\n"), (3, "A LONG LINE HERE\n\nother text of two\n")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("share", [1, 4, 1 << 40])
def test_null_ids(spark, monkeypatch, share):
    """The same rows with all keys streamed, some and all of them hot."""
    monkeypatch.setattr(op, "HOT_SHARE", share)
    shared = [(None, "a long line here"), (None, "a long line here"), (1, "a long line here"), (2, "a long line here\nof two documents"), (3, "a long line here")]
    rows = shared + [(i, f"line of {i} alone\nof two documents") for i in range(4, 3000)]
    got = op.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    low = sorted((str(r.doc_id), r.n_dropped, r.kept_text) for r in got if r.doc_id is None or r.doc_id < 4)
    assert low == [("1", 0, "a long line here"), ("2", 1, "of two documents"), ("3", 1, ""), ("None", 0, "a long line here"), ("None", 0, "a long line here")]
    assert all(r.n_dropped == 1 for r in got if r.doc_id and r.doc_id > 3)


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 4)
    rows = [(i, f"the hot line of all\nline number {i // 2}\nthe hot line of all") for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_long_document_and_clashing_columns(spark):
    text = "\n".join(f"line number {i % 700}" for i in range(20_000))
    docs = spark.createDataFrame([Row(doc_id=1, text=text, pos=1, h1="x", tk=3, n_lines=0, runs=1), Row(doc_id=2, text=text, pos=1, h1="x", tk=3, n_lines=0, runs=1)])
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in op.dedup_lines(docs).collect()}
    assert got == {1: (20_000, 0, text), 2: (20_000, 20_000, "")}


def test_bitmap(spark):
    docs = spark.createDataFrame([(1, "aaaaaaaaaa\nbbbbbbbbbb"), (2, "x\naaaaaaaaaa\nBBBBBBBBBB\ny\nbbbbbbbbbb")], "doc_id long, text string")
    assert [(r.doc_id, r.n_dropped, [tuple(x) for x in r.runs]) for r in op.keep_bitmaps(docs).collect()] == [(2, 3, [(1, 2), (4, 4)])]
