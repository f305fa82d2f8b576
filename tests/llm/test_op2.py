import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row

from folioflow.llm import op2_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op2_bpe.load_ranks(PATH), special_tokens={})


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "Hello world", "Hello  world", "  Hello\n\n  world \n", "it's we've I'll 12345 67", "x y z", "\n\nfoo bar", "tab\tand \t mixed",
    "é à ü ß 漢字 👍🏽 ́", "***%%% &&& <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "\x1c\x1d x\x1ey \x85 z", "word " * 5000, "　full   width",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_ranks(reference, text):
    coder = op2_bpe.codec(PATH, P.PATTERN)
    ids = coder.encode(text)
    assert ids == " ".join(map(str, reference.encode_ordinary(text)))
    assert coder.decode(ids) == text.encode()


def test_forgetting_changes_nothing(reference):
    small = op2_bpe.Codec(PATH, P.PATTERN, remembered=3)
    for text in TEXTS:
        assert small.encode(text) == " ".join(map(str, reference.encode_ordinary(text)))


def test_table(spark, reference):
    rows = [Row(doc_id=i, text=t, ids="clash", decoded=1) for i, t in enumerate([*TEXTS, None, "Hello world"])]
    rows.append(rows[6])
    got = op2_bpe.encode_documents(spark.createDataFrame(rows), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id].text or ""
        want = reference.encode_ordinary(text)
        assert (list(r.ids), r.n_tokens, bytes(r.decoded)) == (want, len(want), text.encode())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert op2_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        op2_bpe.serialised_model({b"a": 0})
