"""WARC archives with a two-level capture index.

Captures are dealt by range of their reversed-host URL keys, then ids and digests, so that pages that
share an url or an id, or have none, are captures of their own. Each partition writes one archive of
gzip members, a record each, and beside it an index: its sorted lines cut into compressed blocks, and
a sparse directory of each block's first and last line, offset and length. A reader binary-searches the
directory, range-reads one block, binary-searches its lines and range-reads one record. A revisit is
resolved the same way: its response is looked up and read.

Files go to a folder that all executors share and carry a name that no two attempts share, so a
lost or repeated attempt leaves files that no directory names. Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Index lines of a block.
BLOCK_LINES = 256
#: Columns of the directory; an archive and its index share a name.
DIRECTORY = ("first_key", "first_id", "first_digest", "last_key", "last_id", "last_digest", "archive", "offset", "length")
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str = "url") -> Column:
    """Key of a url column: host labels reversed and joined by commas, ``)``, then the rest from the path on.

    Scheme, user, port and ``www.`` go, A-Z of the host are lower-cased. Null gives an empty key; a url without ``://`` is kept
    whole behind a ``)``.
    """
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    host, path = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    host = F.regexp_replace(F.split_part(F.substring_index(host, "@", -1), F.lit(":"), F.lit(1)), "^(?i:www)\\.", "")
    labels = F.reverse(F.split(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[.]"))
    known = F.concat(F.concat_ws(",", labels), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(F.col(url).isNull(), F.lit("")).when(F.instr(url, "://") == 0, F.concat(F.lit(")"), F.col(url))).otherwise(known)


def page_key(page: str = "page_id") -> Column:
    """An id as the index writes it; empty for none."""
    return F.coalesce(F.col(page).cast("string"), F.lit(""))


def _open(where: str) -> tuple[fs.FileSystem, str]:
    if where.startswith("file:") or "://" not in where:
        return fs.LocalFileSystem(), "/" + where.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(where)


def _header(value) -> str:
    """A value fit for a header line: what is not printable ASCII is percent-encoded."""
    return quote(str(value), safe="!#$&'()*+,/:;=?@[]~%-._")


def record(page: str, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None, refers_url: str | None, refers_key: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without one that says how the index files its response."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}", f"WARC-Refers-To-Date: {DATE}",
            f"WARC-Refers-To-Key: {quote(refers_key or '', safe='')}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


#: Where in the scan a row stood: rows that agree in all else still spread over several tasks.
SALT = "__salt"


def captures(pages: DataFrame) -> DataFrame:
    """What each page's record will hold: ``key, page, url, payload, digest, size`` and the response it revisits.

    Of equal payloads of at least 100 bytes the smallest ``page_id`` has the response, and rows that share this id with it. Pages
    without an id come after all others; payloads that only they have are responses. A null html is an empty payload.
    """
    own = pages.select("page_id", page_key().alias("page"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.spark_partition_id().alias(SALT))
    own = own.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    large = own.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
    first = large.agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = common.written(first.select("digest", page_key("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), "n"), "payloads")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    none = F.lit(None).cast("string")
    alone = own.join(first.select("digest"), "digest", "left_anti").withColumns({"refers_to": none, "refers_url": none})
    shared = common.join_by_key(own, first, "digest", total)
    revisits = F.col("page") != F.col("refers_to")
    shared = shared.withColumns({"refers_url": F.when(revisits, F.col("refers_url")), "refers_to": F.when(revisits, F.col("refers_to"))})
    rows = alone.unionByName(shared.select(*alone.columns)).withColumn("key", url_key())
    return rows.withColumn("refers_key", F.when(F.col("refers_to").isNotNull(), url_key("refers_url"))).drop("page_id")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write captures to archives under ``folder``.

    Returns the directory, a row for each block: its first and last line, the archive, and its place in the archive's index.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {'long' if c in ('offset', 'length') else 'string'}" for c in DIRECTORY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name = uuid.uuid4().hex
        archive, index = f"{base}/{name}.warc.gz", f"{base}/{name}.cdx"
        blocks, lines, at, index_at = [], [], 0, 0

        def flush(out) -> None:
            nonlocal lines, index_at
            body = zlib.compress("".join(json.dumps(x, ensure_ascii=True) + "\n" for x in lines).encode(), 6)
            out.write(body)
            blocks.append((*lines[0][:3], *lines[-1][:3], name, index_at, len(body)))
            index_at += len(body)
            lines = []

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is not None:
            system.create_dir(base, recursive=True)
            with system.open_output_stream(archive, compression=None) as out, system.open_output_stream(index, compression=None) as idx:

                def put(batch: pa.RecordBatch) -> None:
                    nonlocal at
                    for key, page, url, payload, digest, size, *refers in zip(*(c.to_pylist() for c in batch.columns)):
                        raw = record(page, url, digest, size, payload if refers[0] is None else None, *refers)
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        lines.append((key, page, digest, at, len(member)))
                        at += len(member)
                        if len(lines) == BLOCK_LINES:
                            flush(idx)

                put(first)
                for batch in batches:
                    put(batch)
                if lines:
                    flush(idx)
        columns = list(zip(*blocks)) if blocks else [[]] * len(DIRECTORY)
        types = [pa.string()] * 7 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], list(DIRECTORY))

    # the key's range decides the archive; many captures of one key spread over archives by their ids and digests
    order = ("key", "page", "digest")
    dealt = rows.repartitionByRange(parts, *order, SALT).sortWithinPartitions(*order)
    directory = dealt.select("key", "page", "url", "payload", "digest", "size", "refers_to", "refers_url", "refers_key").mapInArrow(run, schema)
    path = f"{folder}/directory"
    # few files, in order of keys, as a reader opens them all
    order = ("first_key", "first_id", "first_digest")
    directory.repartitionByRange(max(1, parts // 64), *order).sortWithinPartitions(*order).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Archives:
    """Reads captures through the directory's blocks; keeps the last block and the open files."""

    def __init__(self, folder: str, directory: list[tuple]):
        self.system, self.base = _open(folder)
        # equal lines may fill several blocks; of blocks that start alike the one that ends last comes last
        self.directory = sorted(directory)
        self.firsts = [x[:3] for x in self.directory]
        self.block: tuple[int, list] = (-1, [])
        self.files: dict[str, object] = {}

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 8:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.base}/{name}")
        return self.files[name].read_at(length, offset)

    def _lines(self, at: int) -> list[list]:
        archive, offset, length = self.directory[at][6:]
        if self.block[0] != at:
            self.block = (at, [json.loads(x) for x in zlib.decompress(self._range(f"{archive}.cdx", offset, length)).splitlines()])
        return self.block[1]

    def _record(self, at: int, line: list) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse(zlib.decompress(self._range(f"{self.directory[at][6]}.warc.gz", *line[3:]), 31))

    def find(self, key: str, page: str, digest: str) -> tuple[dict[str, str], dict[str, str], bytes] | None:
        """The record of a capture: two binary searches, two range reads."""
        at = bisect_right(self.firsts, (key, page, digest)) - 1
        if at < 0:
            return None
        lines = self._lines(at)
        k = bisect_right(lines, [key, page, digest, float("inf")]) - 1
        return self._record(at, lines[k]) if k >= 0 and lines[k][:3] == [key, page, digest] else None

    def captures(self, key: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """All captures of a key, in order of their ids and digests."""
        for at in range(max(0, bisect_left(self.firsts, (key,)) - 1), bisect_right(self.firsts, (key, "\U0010ffff"))):
            for line in [x for x in self._lines(at) if x[0] == key]:
                yield self._record(at, line)


def _found(wanted: DataFrame, folder: str, with_payload: bool) -> DataFrame:
    """The record of each row of ``wanted (key, page, digest, salt)``, a response's size and digest taken anew from its payload.

    Captures are sorted by key in ranges, so a batch needs a few neighbouring blocks and reads only those
    rows of the directory that can hold them. One that is missing or damaged fails.
    """
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["key", "page", "digest", "record_type", "size", "payload", "refers_key", "refers_to"]
    types = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        directory = None
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            keys, pages, digests = (c.to_pylist() for c in batch.columns)
            directory = directory or dataset.dataset(f"{base}/directory", filesystem=system, format="parquet")
            near = directory.to_table(filter=(dataset.field("first_key") <= max(keys)) & (dataset.field("last_key") >= min(keys)))
            archives = Archives(folder, list(zip(*(near.column(c).to_pylist() for c in DIRECTORY))))
            out = []
            for key, page, digest in zip(keys, pages, digests):
                found = archives.find(key, page, digest)
                if found is None:
                    raise LookupError(f"no capture of page {page} under {key}")
                warc, http, payload = found
                if warc["WARC-Type"] == "revisit":
                    out.append((key, page, digest, "revisit", None, None, unquote(warc["WARC-Refers-To-Key"]), warc["WARC-Refers-To"][len("<urn:page:") : -1]))
                    continue
                read = hashlib.sha256(payload).hexdigest()
                if len(payload) != int(http["Content-Length"]) or read != warc["WARC-Payload-Digest"].partition(":")[2]:
                    raise ValueError(f"the record of page {page} is damaged")
                out.append((key, page, read, "response", len(payload), payload if with_payload else None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    order = ("key", "page", "digest")
    dealt = wanted.repartitionByRange(parts, *order, SALT).sortWithinPartitions(*order)
    return dealt.select(*order).mapInArrow(run, "key string, page string, digest string, record_type string, size long, payload binary, refers_key string, refers_to string")


def read_archives(wanted: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Look up each ``page_id, url, digest`` of ``wanted``: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and ``payload``.

    ``digest`` is the payload's SHA-256, which tells captures that share url and id apart. A revisit is resolved through the index: its
    response is looked up and read, and size, digest and payload are the response's.
    """
    kind = dict(wanted.dtypes)["page_id"]
    asked = wanted.select(url_key().alias("key"), page_key().alias("page"), "digest", F.spark_partition_id().alias(SALT))
    found = common.written(_found(asked, folder, with_payload), "found")
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    # a digest has one response, the one its revisits name
    named = revisits.groupBy("digest").agg(F.first("refers_key").alias("key"), F.first("refers_to").alias("page"), F.count("*").alias("n"))
    named = common.written(named, "named")
    read = common.written(_found(named.withColumn(SALT, F.lit(0)), folder, with_payload), "read")
    sizes = read.select("digest", "size", "payload").join(named.select("digest", "n"), "digest")
    resolved = common.join_by_key(revisits.drop("size", "payload"), sizes, "digest", named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    columns = [page("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")]
    both = responses.unionByName(resolved.select(*responses.columns))
    return both.select(*columns, *(["payload"] if with_payload else []))


def store_and_read(pages: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Archive every row of ``pages (page_id, url, html)`` under ``folder``, then read each back through the index.

    Null html is an empty payload, null urls have an empty key, pages without an id an empty one; rows that share an id are told
    apart by their digests. Repeated rows are archived and read back as often as they occur. Other columns
    are dropped; an empty table gives no rows.
    """
    write_archives(captures(pages), folder)
    wanted = pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    return read_archives(wanted, folder, with_payload)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                  CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
