"""Removal of repeated byte strings by a distributed difference-cover comparison of suffixes.

A string of LENGTH bytes that starts at i is repeated if it starts anywhere else. Every two positions
i and j have an offset d under COVER's modulus v such that i + d and j + d are both in the cover's
sample. So sampled suffixes are named by their first t = LENGTH - v + 1 bytes, which lie in any
repeated string through them, and only suffixes with a common name have to be told apart:

1. Screen. A string's least hash of its K-byte parts is the same wherever it stands; strings whose
   least part stands at one place only are not repeated and take no further part.
2. Sample. Sampled suffixes p get a name, the hash of their t-byte tuple, and a context, the hash of
   all bytes of the v strings that start in [p - v + 1, p]. Names are sorted in buckets. If a context
   comes twice, all v strings are repeated. If a name has several contexts, its suffixes recur to 3.
3. Merge. Of these, the strings of each context's first place are sorted by the hash of all their
   bytes, and adjacent equal ones are repeated.

Order within the sorts is that of hashes, as equality is all that counts. The texts are dealt into
blocks, written once to the shared folder and read by the tasks that need them; only hashes travel,
and a bit for each comes back. A hash goes out once a block, so any number of copies costs no more
than their bytes. Names and screens may be taken for equal wrongly, which costs work and no result;
contexts and strings are told apart by two independent 64-bit hashes.

Texts over PIECE bytes are cut into pieces, blocks of their own, so that memory follows no text's length.
A piece owns the strings that start in it and overlaps its neighbours by as much as these strings' samples
need. Samples near a cut may be seen by both pieces; they go out with their place, which counts once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op8_warc import _open

LENGTH = 200
#: A difference cover: the differences of its members are all residues of the modulus.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of the parts of the screen.
PART = 120
#: Bytes of a block, give or take a document; a task holds some ten arrays of eight times as many.
BLOCK = 1 << 18
#: Bytes of a piece of a long text, about; texts up to five quarters of it stay whole.
PIECE = 1 << 20
#: Least number of buckets of hashes, and bytes of text for each; the number follows the input, not the
#: partitions, so that a block sends as many rows at every size until the input outgrows the least number.
BUCKETS, BUCKET = 64, 1 << 25

#: Two independent hashes: random numbers for bytes, and a base.
_TABLES = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, list[np.ndarray]] = {0: [np.ones(1, np.uint64)] * 2, 1: [np.ones(1, np.uint64)] * 2}


def _grown(which: int, n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if len(_powers[which][0]) < n:
        base = _BASES[which]
        for k, factor in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(n + (n >> 2), np.uint64(factor))
            steps[0] = 1
            _powers[which][k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Bytes:
    """The documents of a block, or a piece of one, end to end, with hashes of any part of them.

    Of a piece that starts at byte ``start`` of document ``origin``, strings that start in ``[first, last)`` are its own.
    """

    def __init__(self, texts: list[bytes], piece: tuple[int, int, int, int] | None = None):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.n = len(self.raw)
        self._sums: dict[int, np.ndarray] = {}
        #: Bytes from each position to the end of its document.
        self.left = np.repeat(self.ends, self.sizes) - np.arange(self.n)
        self.before = np.arange(self.n) - np.repeat(self.ends - self.sizes, self.sizes)
        self.origin, self.start, self.first, self.last = piece or (0, 0, 0, self.n)
        #: Whether a string of the block's own starts at a position.
        self.whole = self.left >= LENGTH
        self.whole[: self.first] = False
        self.whole[self.last :] = False
        #: Samples from here on, and up to here, may be seen by another piece too.
        self.border = (self.first + MODULUS if piece and self.start + self.first else 0, self.last if piece else self.n)

    def sums(self, which: int) -> np.ndarray:
        if which not in self._sums:
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_TABLES[which][self.raw] * _grown(which, self.n + 1)[0][: self.n], out=out[1:])
            self._sums[which] = out
        return self._sums[which]

    def hash(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        sums = self.sums(which)
        return _mixed((sums[at + length] - sums[at]) * _grown(which, self.n + 1)[1][at])

    def all_hashes(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        sums = self.sums(0)
        return _mixed((sums[length:] - sums[:n]) * _grown(0, self.n + 1)[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above the low 32 bits."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _runs(mask: np.ndarray) -> np.ndarray:
    """First and one past the last position of each run, as a flat array."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8))).astype(np.int32)


def _mask(runs: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int8)
    steps[runs[0::2]] += 1
    steps[runs[1::2]] -= 1
    return np.cumsum(steps[:n], dtype=np.int8).view(bool)


def _by_bucket(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Cut columns sorted by ``key`` at each new bucket."""
    bucket = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else []
    for s, e in zip(cuts, cuts[1:]):
        yield int(bucket[s]), tuple(c[s:e] for c in columns)


def _answers(key: np.ndarray, rows: dict[int, bytes], n_bits: int) -> list[np.ndarray]:
    """Bits that came back for entries sorted by ``key``: a bucket without an answer has none set."""
    out = [np.zeros(len(key), bool) for _ in range(n_bits)]
    place = np.arange(len(key))
    for bucket, (at,) in _by_bucket(key, place):
        if bucket in rows:
            bits = np.unpackbits(np.frombuffer(rows[bucket], np.uint8))[: n_bits * len(at)].astype(bool)
            for k in range(n_bits):
                out[k][at] = bits[k * len(at) : (k + 1) * len(at)]
    return out


# 1. screen


def screen(b: Bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least part of the string at each position (all ones where none starts), sorted distinct keys, how often each is at hand."""
    width = LENGTH - PART + 1
    if b.n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = b.all_hashes(PART)
    parts[b.left[: len(parts)] < PART] = _MAX
    least = sliding(parts, width, np.minimum)[: b.n - LENGTH + 1]
    whole = b.whole[: len(least)]
    # a part is a least one if it is that of some string it lies in
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(whole, least, 0), np.zeros(width - 1, np.uint64)])
    used = sliding(padded, width, np.maximum)[: len(parts)] == parts
    keys, counts = np.unique(_key(parts[used & (parts != _MAX)], buckets), return_counts=True)
    return np.where(whole, least, _MAX), keys, counts


def candidates(b: Bytes, buckets: int, rows: dict[int, bytes]) -> np.ndarray:
    """Positions whose string's least part stands elsewhere too."""
    least, keys, counts = screen(b, buckets)
    out = np.zeros(b.n, bool)
    if len(keys):
        again = _answers(keys, rows, 1)[0] | (counts > 1)
        turns = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        values = least[turns]
        at = np.minimum(np.searchsorted(keys, _key(values, buckets)), len(keys) - 1)
        hit = again[at] & (keys[at] == _key(values, buckets)) & (values != _MAX)
        out[: len(least)] = np.repeat(hit, np.diff(np.concatenate([turns, [len(least)]])))
    return out


# 2. sample


def sampled(b: Bytes, candidate: np.ndarray) -> np.ndarray:
    """Positions of the cover's sample that a candidate string passes through, with room for a tuple."""
    before = np.concatenate([[0], np.cumsum(candidate, dtype=np.int64)])
    at = np.arange(b.n)
    at = at[np.isin(at % MODULUS, COVER) & (b.left >= LENGTH - MODULUS + 1)]
    return at[before[at + 1] > before[at - np.minimum(b.before[at], MODULUS - 1)]]


class Names:
    """Distinct samples of a block sorted by bucket: name key, context's two hashes, how often at hand (two at most), or the place near a cut."""

    def __init__(self, b: Bytes, at: np.ndarray, block: int, buckets: int):
        key = _key(b.hash(at, LENGTH - MODULUS + 1), buckets)
        # where a document has not all bytes of the context, it is one of its own
        context = _mixed((at.astype(np.uint64) << np.uint64(20)) ^ np.uint64((block * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        other = context ^ _MAX
        full = (b.before[at] >= MODULUS - 1) & (b.left[at] >= LENGTH)
        for which, column in enumerate((context, other)):
            column[full] = b.hash(at[full] - (MODULUS - 1), LENGTH + MODULUS - 1, which)
        place = np.zeros(len(at), np.uint64)
        near = (at < b.border[0]) | (at >= b.border[1])
        place[near] = _mixed((at[near] + b.start).astype(np.uint64) ^ np.uint64(b.origin)) | np.uint64(1)
        bucket = key >> np.uint64(32)
        order = np.lexsort((place, other, context, key, near, bucket)) if near.any() else np.lexsort((other, context, key))
        columns = [x[order] for x in (key, context, other, place)]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
        self.key, self.context, self.other, self.place = (x[new] for x in columns)
        #: The entry of each position.
        self.entry = np.empty(len(at), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.weight = np.where(self.place > 0, 0, np.minimum(np.bincount(self.entry, minlength=len(self.key)), 2)).astype(np.uint8)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """What goes to each bucket: plain entries, then those near a cut with their places."""
        for bucket, (k, c, o, p, w) in _by_bucket(self.key, self.key, self.context, self.other, self.place, self.weight):
            plain = int((p == 0).sum())
            yield bucket, b"".join([np.array([plain], "<u4").tobytes(), k.astype("<u4").tobytes(), c.tobytes(), o.tobytes(), w[:plain].tobytes(), p[plain:].tobytes()])


def _through(at: np.ndarray, b: Bytes) -> np.ndarray:
    """Positions of the strings that pass through ``at`` within the modulus, in the same document."""
    steps = np.zeros(b.n + 1, np.int32)
    np.add.at(steps, at - np.minimum(b.before[at], MODULUS - 1), 1)
    np.add.at(steps, at + 1, -1)
    return np.cumsum(steps[: b.n]) > 0


def split(b: Bytes, candidate: np.ndarray, block: int, buckets: int, rows: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings known to be repeated, and those that are left to merge."""
    at = sampled(b, candidate)
    if not len(at):
        return np.zeros(b.n, bool), np.zeros(b.n, bool)
    names = Names(b, at, block, buckets)
    again, open_ = _answers(names.key, rows, 2)
    again |= names.weight > 1
    return _through(at[again[names.entry]], b) & b.whole, _through(at[open_[names.entry]], b) & candidate & b.whole


# 3. merge


def strings(b: Bytes, open_: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, distinct pairs of hashes sorted by key with their keys, the place of each position, how often each is at hand."""
    at = np.flatnonzero(open_)
    h, g = b.hash(at, LENGTH), b.hash(at, LENGTH, 1)
    key = _key(h, buckets)
    order = np.lexsort((g, h, key))
    hs, gs = h[order], g[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    place = np.empty(len(hs), np.int64)
    place[order] = np.cumsum(new) - 1
    return at, key[order][new], hs[new], gs[new], place, np.bincount(place, minlength=int(new.sum()))


def merged(b: Bytes, repeated: np.ndarray, open_: np.ndarray, buckets: int, rows: dict[int, bytes]) -> np.ndarray:
    at, key, _, _, place, counts = strings(b, open_, buckets)
    if len(at):
        again = _answers(key, rows, 1)[0] | (counts > 1)
        repeated = repeated.copy()
        repeated[at[again[place]]] = True
    return repeated


def covered(n: int, repeated: np.ndarray) -> np.ndarray:
    """Which of n bytes the strings at the marked positions cover."""
    at = np.flatnonzero(repeated)
    steps = np.zeros(n + 1, np.int64)
    steps[at] += 1
    np.add.at(steps, at + LENGTH, -1)
    return np.cumsum(steps[:n]) > 0


# what a bucket answers: entries of each block to bits


def _twice(entries: list[tuple[np.ndarray, ...]]) -> list[bytes]:
    """Bit by entry: whether another block has it. Columns of each block, equal in all."""
    columns = [np.concatenate(x) for x in zip(*entries)]
    order = np.lexsort(columns) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    again = np.zeros(len(order), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(again, np.cumsum([len(e[0]) for e in entries])[:-1])]


def answer_screen(blobs: list[bytes]) -> list[bytes]:
    return _twice([(np.frombuffer(x, "<u4"),) for x in blobs])


def answer_strings(blobs: list[bytes]) -> list[bytes]:
    return _twice([(np.frombuffer(x, "<u8", len(x) // 16), np.frombuffer(x, "<u8", len(x) // 16, len(x) // 2)) for x in blobs])


def _read_names(blob: bytes) -> tuple[np.ndarray, ...]:
    plain = int(np.frombuffer(blob, "<u4", 1)[0])
    n = plain + (len(blob) - 4 - 21 * plain) // 28
    at = 4
    out = []
    for kind, size, count in (("<u4", 4, n), ("<u8", 8, n), ("<u8", 8, n), ("u1", 1, plain), ("<u8", 8, n - plain)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += size * count
    weight, place = np.zeros(n, np.uint8), np.zeros(n, np.uint64)
    weight[:plain], place[plain:] = out[3], out[4]
    return out[0], out[1], out[2], weight, place


def answer_names(blobs: list[bytes]) -> list[bytes]:
    """Two bits by entry: whether the context stands at two places, and whether the name's contexts differ and this entry's strings stand for its context.

    Those of a context's first place do, or of all its places if one is near a cut, as its strings are not all one piece's own.
    """
    read = [_read_names(x) for x in blobs]
    name, context, other, weight, place = (np.concatenate(x) for x in zip(*read))
    order = np.lexsort((place, other, context, name)) if place.any() else np.lexsort((other, context, name))  # stable: blocks stay in order
    n, c, o, w, p = name[order], context[order], other[order], weight[order], place[order]
    other_name = np.ones(len(n), bool)
    other_name[1:] = n[1:] != n[:-1]
    first = other_name.copy()
    first[1:] |= (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    of = np.cumsum(first) - 1
    new_place = (p > 0) & (first | np.concatenate([[True], p[1:] != p[:-1]]))
    again = (np.bincount(of, w) + np.bincount(of, new_place))[of] >= 2
    cut = (np.bincount(of, p > 0) > 0)[of]
    group = np.cumsum(other_name) - 1
    several = np.bincount(group, first)[group] > 1
    bits = np.empty((2, len(n)), bool)
    bits[0, order], bits[1, order] = again, several & (first | ~again | cut)
    cuts = np.cumsum([len(r[0]) for r in read])[:-1]
    return [np.packbits(np.concatenate([x, y])).tobytes() if x.any() or y.any() else b"" for x, y in zip(np.split(bits[0], cuts), np.split(bits[1], cuts))]


# tasks

ROUND = "bucket int, block long, kind int, blob binary"
_NAMES = ["bucket", "block", "kind", "blob"]
_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
#: Kinds of rows: where a block is, what is known of it, entries (and what is answered to them).
PLACE, STATE, ENTRIES = 0, 1, 2
#: Numbers of blocks that are pieces have this bit.
PIECES = 1 << 62


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], _NAMES)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").to_pylist()]


def cut(size: int) -> list[tuple[int, int]]:
    """First and one past the last string start of each piece of a text; one piece where it stays whole."""
    n = max(1, (size + PIECE // 4) // PIECE) if size > PIECE + PIECE // 4 else 1
    at = [size * k // n for k in range(n + 1)]
    return list(zip(at, at[1:]))


def _write_blocks(folder: str, buckets: int) -> Callable:
    """Documents to blocks in the shared folder; rows say where each is and send its screen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name, block, at, out = uuid.uuid4().hex, TaskContext.get().partitionId() << 24, 0, None
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch], piece: list | None = None) -> pa.RecordBatch:
            nonlocal block, at, out
            table = pa.Table.from_batches(rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            body = sink.getvalue()
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            out.write(body)
            number = block | PIECES if piece else block
            place = json.dumps([name, at, body.size, piece]).encode()
            sent = [(number % buckets, number, PLACE, place)]
            _, keys, _ = screen(Bytes(_texts(table.to_batches()[0]), piece and tuple(piece[:4])), buckets)
            sent += [(k, number, ENTRIES, x.tobytes()) for k, (x,) in _by_bucket(keys, keys.astype("<u4"))]
            block, at = block + 1, at + body.size
            return _batch(sent)

        size = 0
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
            start = 0
            for k, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
                bounds = cut(n)
                if len(bounds) > 1:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    start, row, own = k + 1, batch.slice(k, 1), text[k].as_py()
                    origin = block * 0x9E3779B97F4A7C15 & (1 << 62) - 1  # the same in any attempt
                    for number, (s, e) in enumerate(bounds):
                        low, high = max(0, s - MODULUS), min(n, e + MODULUS + LENGTH)
                        part = row.set_column(row.schema.get_field_index("text"), "text", pa.array([own[low:high]], pa.binary()))
                        yield flush([part], [origin, low, s - low, e - low, number, n])
                    continue
                size += n
                if size >= BLOCK:
                    held.append(batch.slice(start, k + 1 - start))
                    start, size = k + 1, 0
                    yield flush(held)
                    held.clear()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush(held)
        if out is not None:
            out.close()

    return run


def _answer(how: Callable[[list[bytes]], list[bytes]]) -> Callable:
    """Rows sorted by bucket, kind and block: what is no entry passes, entries of a bucket are answered together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, blobs = None, [], []

        def flush() -> list[tuple]:
            out = [(now, block, ENTRIES, bits) for block, bits in zip(blocks, how(blobs)) if bits] if blobs else []
            blocks.clear()
            blobs.clear()
            return out

        for batch in batches:
            out = []
            for bucket, block, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    out += flush()
                    now = bucket
                if kind == ENTRIES:
                    blocks.append(block)
                    blobs.append(blob)
                else:
                    out.append((bucket, block, kind, blob))
            yield _batch(out)
        yield _batch(flush())

    return run


def _stored(body) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def _each_block(folder: str, do: Callable) -> Callable:
    """Rows sorted by block, kind and bucket: read each block and do the rest with what came for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        now, place, state, rows, file, opened = None, None, None, {}, None, None

        def flush():
            nonlocal file, opened
            name, at, size, piece = json.loads(place)
            if opened != name:
                file, opened = system.open_input_file(f"{base}/{name}"), name
            batch = _stored(file.read_at(size, at))
            return do(batch, Bytes(_texts(batch), piece and tuple(piece[:4])), now, place, state, rows)

        for batch in batches:
            for bucket, block, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield from flush()
                    now, place, state, rows = block, None, None, {}
                if kind == PLACE:
                    place = blob
                elif kind == STATE:
                    state = blob
                else:
                    rows[bucket] = blob
        if now is not None:
            yield from flush()

    return run


def _pack(*runs: np.ndarray) -> bytes:
    return b"".join(np.array([len(r)], "<i4").tobytes() + r.astype("<i4").tobytes() for r in runs)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    whole = np.frombuffer(blob, "<i4")
    while at < len(whole):
        out.append(whole[at + 1 : at + 1 + whole[at]])
        at += 1 + int(whole[at])
    return out


def dedup_suffixes(docs: DataFrame, folder: str | None = None, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Remove every byte of ``text`` that a repeated string of ``LENGTH`` bytes covers.

    Returns ``doc_id``, the columns ``carry``, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if ``with_text``,
    ``spans`` (first and one past the last byte of each removed run) and ``kept_text``, in which a
    character goes only if all its bytes do. Strings never cross documents and are judged on the input.
    Null texts count as empty and stay null; texts shorter than a string stay whole. Rows that repeat
    repeat each other's strings. Columns not carried are dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or common.scratch_path(spark, "blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-total // BUCKET))

    def answered(sent: DataFrame, how: Callable, name: str) -> DataFrame:
        dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "block")
        return common.written(dealt.mapInArrow(_answer(how), ROUND), name)

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")

    def to_names(batch, b, block, place, state, rows):
        candidate = candidates(b, buckets, rows)
        out = [(block % buckets, block, PLACE, place), (block % buckets, block, STATE, _pack(_runs(candidate)))]
        at = sampled(b, candidate) if candidate.any() else np.zeros(0, np.int64)
        if len(at):
            out += [(k, block, ENTRIES, blob) for k, blob in Names(b, at, block, buckets).blobs()]
        yield _batch(out)

    def to_strings(batch, b, block, place, state, rows):
        repeated, open_ = split(b, _mask(_unpack(state)[0], b.n), block, buckets, rows)
        out = [(block % buckets, block, PLACE, place), (block % buckets, block, STATE, _pack(_runs(repeated), _runs(open_)))]
        if open_.any():
            _, key, h, g, _, _ = strings(b, open_, buckets)
            out += [(k, block, ENTRIES, x.tobytes() + y.tobytes()) for k, (x, y) in _by_bucket(key, h.astype("<u8"), g.astype("<u8"))]
        yield _batch(out)

    kept = ["doc_id", *carry]
    result = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept_text"] if with_text else [])]

    def row_of(own: np.ndarray, gone: np.ndarray, is_null: bool) -> list:
        spans = _runs(gone) if gone.any() else np.zeros(0, np.int32)
        row = [len(own), int(gone.sum()), len(spans) // 2, hashlib.sha256(own[~gone].tobytes() if len(spans) else own.tobytes()).hexdigest()]
        if with_text:
            if len(spans):
                starts = np.flatnonzero((own & 0xC0) != 0x80)
                own = own[~np.repeat(np.minimum.reduceat(gone, starts), np.diff(np.concatenate([starts, [len(own)]])))]
            row += [spans.reshape(-1, 2).tolist(), None if is_null else own.tobytes().decode("utf-8")]
        return row

    def results(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.list_(pa.int32())), pa.string()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], [*kept, *result])

    def to_results(batch, b, block, place, state, rows):
        repeated, open_ = (_mask(r, b.n) for r in _unpack(state))
        gone = covered(b.n, merged(b, repeated, open_, buckets, rows))
        null = batch.column("text").is_null().to_pylist()
        yield results(batch, [row_of(b.raw[s:e], gone[s:e], x) for s, e, x in zip((b.ends - b.sizes).tolist(), b.ends.tolist(), null)])

    def to_piece(batch, b, block, place, state, rows):
        repeated, open_ = (_mask(r, b.n) for r in _unpack(state))
        piece = json.loads(place)[3]
        runs = _runs(merged(b, repeated, open_, buckets, rows)).astype(np.int64) + b.start
        yield pa.RecordBatch.from_arrays([pa.array([piece[0]]), pa.array([piece[4]], pa.int32()), pa.array([place], pa.binary()), pa.array([runs.tolist()], pa.list_(pa.int64()))], ["origin", "piece", "place", "runs"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by text and piece: read the pieces, end to end, and give the whole text's result."""
        system, base = _open(folder)
        raw, repeated, at = None, None, 0
        for batch in batches:
            for place, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, offset, size, (_, low, first, last, _, n) = json.loads(place)
                with system.open_input_file(f"{base}/{name}") as file:
                    own = _stored(file.read_at(size, offset))
                if raw is None:
                    raw, repeated, at = np.empty(n, np.uint8), np.zeros(n, bool), 0
                part = np.frombuffer(own.column("text")[0].as_py(), np.uint8)[first:last]
                raw[at : at + len(part)] = part
                at += len(part)
                for s, e in zip(runs[0::2], runs[1::2]):
                    repeated[s:e] = True
                if at == n:
                    yield results(own, [row_of(raw, covered(n, repeated), False)])
                    raw = None

    sent = docs.select("text", *kept).mapInArrow(_write_blocks(folder, buckets), ROUND)
    known = answered(sent, answer_screen, "screen")
    known = answered(blocks(known).mapInArrow(_each_block(folder, to_names), ROUND), answer_names, "names")
    known = answered(blocks(known).mapInArrow(_each_block(folder, to_strings), ROUND), answer_strings, "strings")
    types = dict(docs.dtypes)
    schema = ", ".join(
        [*(f"{c} {types[c]}" for c in kept), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["spans array<array<int>>, kept_text string"] if with_text else [])]
    )
    short = blocks(known.where(F.col("block") < PIECES)).mapInArrow(_each_block(folder, to_results), schema)
    pieces = blocks(known.where(F.col("block") >= PIECES)).mapInArrow(_each_block(folder, to_piece), "origin long, piece int, place binary, runs array<long>")
    long = pieces.repartition(parts, "origin").sortWithinPartitions("origin", "piece").select("place", "runs").mapInArrow(joined, schema)
    return short.unionByName(long)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT r, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200),
h AS (SELECT s.r, i, md5_number(array_slice(b, i, i + 199)) AS h FROM s JOIN d ON s.r = d.r),
k AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
p AS (SELECT r, i FROM h SEMI JOIN k ON h.h = k.h),
q AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS new FROM p),
g AS (SELECT r, i, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY i) AS run FROM q),
v AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY r, run),
e AS (SELECT r, a, z FROM v UNION ALL SELECT r, n + 1, n + 1 FROM d),
o AS (SELECT e.r, a, z, substr(hex(b), 2 * coalesce(lag(z) OVER (PARTITION BY e.r ORDER BY a), 0) + 1, 2 * (a - 1 - coalesce(lag(z) OVER (PARTITION BY e.r ORDER BY a), 0))) AS kept FROM e JOIN d ON e.r = d.r)
SELECT any_value(doc_id) AS doc_id, any_value(n) AS n_bytes,
       coalesce(CAST(sum(z - a + 1) FILTER (WHERE a <= n) AS BIGINT), 0) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(kept, '' ORDER BY a))) AS kept_sha256
FROM o JOIN d ON o.r = d.r GROUP BY d.r
"""
