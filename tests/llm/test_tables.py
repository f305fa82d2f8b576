"""The registered queries on the smallest tables against brute force and against their SQL."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioflow.llm import op2_bpe, registry
from tests.llm import test_op1, test_op3, test_op4, test_op5, test_op7

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r[0]: r for r in registry.QUERIES[name](spark, SF).collect()}


def test_query_op1(spark, docs):
    got = rows(spark, "op1_quality")
    assert got.keys() == docs.keys()
    for i, g in got.items():
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == test_op1.brute(docs[i])
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.base_failed and g.kept)


def test_query_op2(spark, docs):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op2_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, g in rows(spark, "op2_byte_bpe").items():
        ids = reference.encode_ordinary(docs[i])
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest())


def test_query_op3(spark, docs):
    fp = {i: test_op3.plain(t) for i, t in docs.items()}
    group = test_op3.groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    got = rows(spark, "op3_simhash")
    assert {i: (g.fingerprint, g.component_id) for i, g in got.items()} == {i: (f"{fp[i]:016x}", group[i]) for i in docs}


def test_query_op4(spark, docs):
    want = dict(zip(docs, test_op4.brute([t.encode() for t in docs.values()])))
    got = rows(spark, "op4_suffix_dedup")
    assert {i: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for i, g in got.items()} == {i: w[:4] for i, w in want.items()}


def test_query_op5(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {i: (g.host, g.path, g.rule) for i, g in rows(spark, "op5_url_filter").items()} == {i: test_op5.brute(u) for i, u in urls.items()}


def test_query_op7(spark, docs):
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokens.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    order, got = {i: k for k, i in enumerate(ids)}, registry.QUERIES["op7_packing"](spark, SF).collect()
    test_op7.check([(order[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in got], [len(x) for x in ids.values()], 4096)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))
