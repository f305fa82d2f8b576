import hashlib
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow.llm import op8_warc as op

BIG = "<p>" + "x" * 200
PAGES = [
    (5, "http://www.a.example.com/x?y=1", BIG), (3, "https://b.example.com:8080/", BIG), (9, "http://a.example.com", BIG), (1, "http://c.org/é ü\r\nX: y", "short"), (2, "http://c.org/", "short"),
    (4, None, None), (6, "not a url", ""), (7, "http://user@d.net#top", "é" * 50), (8, "http://d.net/%41", "é" * 50), (10, "://", "\r\n\r\n" * 40),
]


def want(pages):
    first = {}
    for i, _, h in sorted(pages, key=lambda x: x[0]):
        raw = (h or "").encode()
        if len(raw) >= 100:
            first.setdefault(raw, i)
    out = {}
    for i, _, h in pages:
        raw = (h or "").encode()
        f = first.get(raw, i)
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f)
    return out


def digests(pages):
    return pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))


@pytest.mark.parametrize("lines", [1, 2, 256])
def test_round_trip(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(op, "BLOCK_LINES", lines)
    rows = [Row(page_id=i, url=u, html=h, key="clash", digest=1, payload="x", page=0, size="s") for i, u, h in PAGES]
    pages, folder = spark.createDataFrame(rows), f"file:{tmp_path}/warc"
    got = op.store_and_read(pages, folder).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want(PAGES)
    texts = {r.page_id: r.payload for r in op.read_archives(digests(pages), folder).collect()}
    assert len(texts) == len(PAGES) and all(bytes(raw).decode() == (dict((i, h) for i, _, h in PAGES)[i] or "") for i, raw in texts.items())
    # an archive is a row of gzip members, each a record
    for file in (tmp_path / "warc").glob("*.warc.gz"):
        raw = file.read_bytes()
        while raw:
            member = zlib.decompressobj(31)
            assert member.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: ")
            raw = member.unused_data


def test_many_pages_of_one_url(spark, tmp_path):
    pages = [(i, "http://hot.example.com/" if i % 3 else f"http://x{i}.org/", BIG if i % 2 else f"{i}" * 100) for i in range(600)]
    got = op.store_and_read(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/warc").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want(pages)


SCHEMA = "page_id long, url string, html string"


def test_repeated_rows_and_ids(spark, tmp_path):
    rows = [(1, "http://a.b/", BIG)] * 3 + [(1, "http://a.b/", BIG + "2"), (1, "http://c.d/", "x"), (2, "http://a.b/", BIG + "2"), (2, "http://a.b/", BIG), (1, "http://a.b/", "")]
    got = op.store_and_read(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a").collect()
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got)
    size = lambda h: (len(h), hashlib.sha256(h.encode()).hexdigest())
    assert found == sorted((i, *size(h), "response" if i == 1 else "revisit", 0 if i == 1 else 1) for i, _, h in rows)


def test_pages_without_an_id_and_empty_table(spark, tmp_path):
    rows = [(1, "http://a.b/", BIG), (None, "http://a.b/", BIG), (None, None, None), (None, "http://a.b/", BIG + "3"), (None, "http://a.b/", BIG + "3")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = op.store_and_read(pages, f"{tmp_path}/c").collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (0, 0, "response", 0), (0, len(BIG), "revisit", 1), (0, len(BIG) + 1, "response", 0), (0, len(BIG) + 1, "response", 0), (1, len(BIG), "response", 0),
    ]
    assert op.store_and_read(pages.where("false"), f"{tmp_path}/b").collect() == []


def test_captures_of_a_url(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_LINES", 2)
    rows = [(i, "http://a.b/" if i % 2 else f"http://a.b/{i}", f"text {i}") for i in range(20)]
    directory = op.write_archives(op.captures(spark.createDataFrame(rows, SCHEMA)), f"{tmp_path}/w").collect()
    archives = op.Archives(f"{tmp_path}/w", [tuple(r) for r in directory])
    assert sorted(payload.decode() for _, _, payload in archives.captures("b,a)/")) == sorted(h for i, _, h in rows if i % 2)
    assert list(archives.captures("b,a)/none")) == []


def test_missing_capture(spark, tmp_path):
    one = spark.createDataFrame([(1, "http://a.b/", BIG)], SCHEMA)
    op.write_archives(op.captures(one), f"{tmp_path}/w")
    with pytest.raises(Exception, match="no capture"):
        op.read_archives(spark.createDataFrame([(2, "http://a.b/", "0")], "page_id long, url string, digest string"), f"{tmp_path}/w").collect()


KEYS = [
    ("http://www.A.example.com:80/P?q#f", "com,example,a)/P?q#f"), ("https://u@b.org", "org,b)/"), ("x", ")x"), (None, ""), ("http://?a", ")?a"),
    ("http://WWW.a.b/x\ny", "b,a)/x\ny"), ("http://a@b@c.d:1:2/", "d,c)/"), ("", ")"), ("ftp://www.www.a", "a,www)/"),
]


def test_url_key(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(KEYS)], "i int, url string").select("i", op.url_key().alias("key")).collect()
    assert [r.key for r in sorted(rows)] == [k for _, k in KEYS]
