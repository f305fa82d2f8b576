"""Lexical retrieval packing: windows are filled by a seed document and its nearest unused neighbours.

Texts are encoded once and their ids written. BM25's statistics, document frequencies and mean length, are
counted over all documents. Documents are then dealt to shards of a bounded number of tokens by range of their
rarest term that another document has too, so documents that share rare terms meet whatever their place in the
input. Each shard gets an inverted index. A window starts with a seed, the document that the last window cut
or else the next unused one; the index then returns the unused documents of the shard in order of their
BM25 score for all of the seed's terms, and these fill the window greedily. The last one is cut
where the window ends and seeds the next window, so windows are full but for the end of a shard,
whose remainder is dealt into sequences of descending powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op2_bpe import byte_characters

WINDOW = 4096
END_ID = 2
#: Tokens of a shard, give or take one document.
SHARD_TOKENS = 1 << 21
#: Bytes of text, give or take one document, whose words are told apart at once.
CHUNK = 2 << 20
#: Documents that go from and to a worker's encoder at once.
SENT = 512
#: Words remembered by a worker; once as many are known no more are added.
REMEMBERED = 300_000
#: Unknown words that go through the tokenizer together; its time a word grows with the length of a text.
JOINED = 64
K1, B = 1.2, 0.75
#: Terms that one in so many documents of a shard has are kept as a dense matrix and not as postings.
DENSE = 16
#: Texts whose words have to encode alike alone and in place; a tokenizer that fails one encodes whole texts.
PROBES = (
    "Don't stop: it's 12,345.67 -- (x)[y]{z}", "L'été n'est\n\npas  là; Straße ÄÖÜ", "a's'll b've c're'd 'm", "<|endoftext|> < |x| >", "naïve\tcafé\u00a0x e\u0301 ﬁ", "日本語 テキスト ok", "!!! ??? ...a1b2 #$%&*", "UPPER lower MiXeD",
)
#: Composed Latin-1 letters in lower case: one pre-token.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
#: What one byte can tell: line feeds become spaces, capitals are A-Z, punctuation is ASCII's but the apostrophe.
SPACED = bytes.maketrans(b"\n", b" ")
CAPITAL, LETTER, PUNCTUATION = (np.isin(np.arange(256), list(x)) for x in (string.ascii_uppercase.encode(), string.ascii_letters.encode(), string.punctuation.replace("'", "").encode()))
#: The first byte of U+00C0 to U+00FF, all letters but those whose second byte is in ``SIGNS``.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)


def cut_at_spaces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of ``CHUNK`` bytes, give or take one word, without the spaces between them."""
    s = 0
    while 0 <= (e := text.find(b" ", s + CHUNK)):
        yield text[s:e]
        s = e + 1
    yield text[s:]


class WordEncoder:
    """Token ids of texts as little-endian numbers of ``kind``, by a tokenizer that drops white space.

    No pre-token of such a tokenizer crosses a space, a line feed or the place between a letter and ASCII
    punctuation other than an apostrophe, so what stands between them, here a word, is encoded once and
    remembered. The words of many texts are told apart in columns; Python sees each different one once.
    Unknown words are joined by a separator that is a token of its own. Where the tokenizer encodes
    ``PROBES`` otherwise, each text goes through it whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # words of plain letters need no normalisation: the same merges on their bytes' characters
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, WhitespaceSplit()
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered
        # added tokens are found in the text as it is, so no word may end in one
        added = {b for t in self.tokenizer.get_added_tokens_decoder().values() for b in t.content.encode()}
        self.opens = PUNCTUATION & ~np.isin(np.arange(256), list(added))
        single = [(c, ids[0]) for c in "♥★☀☺♪•" if len(ids := self._ids(c)) == 1 and self._ids(f"x {c} y") == [*self._ids("x"), ids[0], *self._ids("y")]]
        self.separator, self.separator_id = single[0] if single else (None, None)
        self.by_word = True
        self.by_word = all(np.frombuffer(x, "<u4").tolist() == self._ids(p) for p, x in zip(PROBES, self.encode(list(PROBES))))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def _joined(self, tokenizer, words: list[str], separator: str | None) -> list[bytes]:
        """Ids of words that hold no separator, many in one call."""
        found: list[bytes] = []
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        encodings = tokenizer.encode_batch_fast([f" {separator} ".join(g) for g in groups], add_special_tokens=False) if separator and groups else [None] * len(groups)
        size = np.dtype(self.kind).itemsize
        for part, encoding in zip(groups, encodings):
            ids = np.array(encoding.ids if encoding else [], self.kind)
            ends = np.flatnonzero(ids == self.separator_id).tolist()
            if len(ends) != len(part) - 1:
                found += [np.array(tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in part]
                continue
            raw, s = ids.tobytes(), 0
            for e in [*ends, len(ids)]:
                found.append(raw[size * s : size * e])
                s = e + 1
        return found

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not known, and of the lower case of those that are letters."""
        known, plain, others, letters = self.known, [], [], set()
        words = b" ".join(new).decode().split(" ")
        for raw, w in zip(new, words):
            low = w.lower()
            if LETTERS(low):
                letters.add(low)
                if low != w:
                    plain.append((raw, low.encode()))
            else:
                others.append(w)
        found = {w.encode(): self._raw(w) for w in others if self.separator is None or self.separator in w}
        rest = [w for w in others if w.encode() not in found]
        found |= zip([w.encode() for w in rest], self._joined(self.tokenizer, rest, self.separator))
        keys = [k for w in letters if (k := w.encode()) not in known]
        mapped = b"\n".join(keys).decode("latin-1").translate(self.shown).split(self.shown[10]) if keys else []
        separator = self.separator and self.separator.encode().decode("latin-1").translate(self.shown)
        found |= zip(keys, self._joined(self.merges, mapped, separator))
        for raw, low in plain:
            found[raw] = found[low] if low in found else known[low]
        return found

    def _words(self, texts: list[bytes], lower: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of each word its place among the different ones, these, and the number of words up to each text's end."""
        joined = b" ".join([*texts, b""]).translate(SPACED)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts])
        # letter, punctuation: a space goes between
        at = np.flatnonzero(self.opens[data[1:]]) + 1
        before = data[at - 1]
        two = (data[at - 2] == LATIN) & (at > 1) & (before != SIGNS[0]) & (before != SIGNS[1])
        opened = at[LETTER[before] | two]
        data = np.insert(data, opened, 32)
        ends += np.searchsorted(opened, ends)
        if lower:
            # a mark after a capital might compose with it otherwise than with the small letter, so only before what is none
            after = np.append(data[1:], np.uint8(32))
            single = (after < 0x80) | (after == LATIN)
            capital = np.flatnonzero(CAPITAL[data] & single)
            first = np.flatnonzero(data[:-1] == LATIN) + 1
            first = first[(data[first] < 0x9F) & (data[first] != SIGNS[0]) & single[first]]
            data[capital] += 32
            data[first] += 32
        blank = np.flatnonzero(data == 32)
        starts = np.zeros(len(blank) + 1, np.int64)
        starts[1:] = blank + 1
        column = pa.Array.from_buffers(pa.large_binary(), len(blank), [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        different = column.dictionary
        total = np.frombuffer(different.buffers()[1], np.int64)[len(different)]
        # each ends in its space
        return column.indices.to_numpy(), different.buffers()[2].slice(0, total).to_pybytes().split(b" ")[:-1], np.searchsorted(blank, ends)

    def _chunk(self, texts: list[bytes], lower: bool) -> list[bytes]:
        index, words, ends = self._words(texts, lower)
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            fresh = self._learn(new)
            if len(self.known) < self.remembered:
                self.known.update(fresh)
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
        table = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // table.itemsize
        starts = np.cumsum(sizes) - sizes
        own = sizes[index]
        stops = np.cumsum(own)
        # the places of all words' ids in the table, one word after the other
        ids = table[np.arange(stops[-1]) + np.repeat(starts[index] - (stops - own), own)]
        cuts = [0, *stops[ends - 1].tolist()]
        return [ids[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as numbers of ``kind``."""
        if not self.by_word:
            return [self._raw(t or "") for t in texts]
        out: list[bytes] = [b""] * len(texts)
        plain = [(k, x) for k, t in enumerate(texts) if t for x in cut_at_spaces(t.encode())]
        # a capital may be all that keeps a text from holding an added token
        for lower in (True, False):
            held, size = [], 0
            own = [(k, x) for k, x in plain if (b"<|" not in x) == lower]
            for n, (k, x) in enumerate(own, 1):
                held.append((k, x))
                size += len(x)
                if size >= CHUNK or n == len(own):
                    for (place, _), ids in zip(held, self._chunk([x for _, x in held], lower)):
                        out[place] += ids
                    held, size = [], 0
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in self.raw(texts)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Statistics:
    """BM25's corpus statistics: the number of documents, their mean length and in how many of them each term is."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, max(mean, 1.0), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        # what the dealing ranks terms by: only those of two documents or more can bring neighbours
        self.rarity = np.where(df > 1, self.idf, -1.0).astype(np.float32)

    @staticmethod
    def of(documents: list[np.ndarray]) -> Statistics:
        df = np.bincount(np.concatenate([np.unique(x) for x in documents]).astype(np.int64))
        return Statistics(len(documents), sum(map(len, documents)) / len(documents), df)


def distinct(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's different ids in order, how often it has each, and where each document's begin, and the end."""
    ids = np.concatenate([np.sort(x) for x in documents])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in documents])])
    first = np.ones(len(ids) + 1, bool)
    first[1:-1] = ids[1:] != ids[:-1]
    first[bounds] = True
    at = np.flatnonzero(first)
    return ids[at[:-1]], np.diff(at), np.searchsorted(at, bounds)


class InvertedIndex:
    """BM25 over the token ids of one shard; terms that many of its documents have are columns of a dense matrix."""

    def __init__(self, documents: list[np.ndarray], statistics: Statistics):
        n = len(documents)
        term, tf, bounds = distinct(documents)
        term, tf = term.astype(np.int64), tf.astype(float)
        self.terms = [term[s:e] for s, e in zip(bounds, bounds[1:])]
        lengths = np.array([len(x) for x in documents], float)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        df = np.bincount(term)
        weight = statistics.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / statistics.mean))
        common_ = np.flatnonzero(df * DENSE > max(n, 4 * DENSE))
        self.column = np.full(len(df), -1, np.int64)
        self.column[common_] = np.arange(len(common_))
        own = self.column[term]
        self.dense = np.zeros((len(common_), n))
        self.dense[own[own >= 0], doc[own >= 0]] = weight[own >= 0]
        # a term that one document has brings it no neighbour
        rest = np.flatnonzero((own < 0) & (df[term] > 1))
        order = rest[np.argsort(term[rest], kind="stable")]
        #: which documents are left, in order
        self.place = np.arange(n)
        self._postings(term[order], doc[order], weight[order])

    def _postings(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight = term, doc, weight
        self.count = np.bincount(term, minlength=len(self.column))
        self.start = np.cumsum(self.count) - self.count

    def keep(self, unused: np.ndarray) -> None:
        """Forget the documents that are used; any may still be a seed."""
        left = unused[self.place]
        at = left[self.doc]
        self.dense, self.place = np.compress(left, self.dense, axis=1), self.place[left]
        self._postings(self.term[at], (np.cumsum(left) - 1)[self.doc[at]], self.weight[at])

    def scores(self, seed: int) -> np.ndarray:
        """Of each document that is left."""
        terms = self.terms[seed]
        column = self.column[terms]
        total = np.zeros(len(self.place))
        # row by row, as a copy of them all would leave the cache
        for c in column[column >= 0].tolist():
            total += self.dense[c]
        terms = terms[column < 0]
        starts, counts = self.start[terms], self.count[terms]
        # the places of all these terms' postings, one term after the other
        at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return total + np.bincount(self.doc[at], self.weight[at], len(self.place))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's terms, best first, ties by place."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & unused[self.place])
        return self.place[found[np.argsort(-score[found], kind="stable")]]


def pack_shard(documents: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that cover each document once; statistics are the documents' own if not given."""
    index = InvertedIndex(documents, statistics or Statistics.of(documents))
    size, start = [len(x) for x in documents], [0] * len(documents)
    unused = np.ones(len(documents), bool)
    pieces, sequence, cut, following = [], 0, -1, 0
    while True:
        seed = cut
        if seed < 0:
            while following < len(size) and not unused[following]:
                following += 1
            if following == len(size):
                return pieces
            seed = following
        unused[seed], cut = False, -1
        space, own = window, []

        def take(d: int) -> None:
            nonlocal space, cut
            n = min(space, size[d] - start[d])
            own.append((d, start[d], n))
            start[d] += n
            space -= n
            unused[d] = False
            if start[d] < size[d]:
                cut = d

        take(seed)
        if space:
            if 4 * np.count_nonzero(unused) < 3 * len(index.place):
                index.keep(unused)
            for d in index.neighbours(seed, unused).tolist():
                take(d)
                if not space:
                    break
        while space:
            while following < len(size) and not unused[following]:
                following += 1
            if following == len(size):
                break
            take(following)
        used = window - space
        lengths = [window] if not space else [1 << b for b in range(window.bit_length(), -1, -1) if used >> b & 1]
        for length in lengths:
            offset = 0
            while offset < length:
                d, s, n = own[0]
                m = min(n, length - offset)
                pieces.append((d, s, m, sequence, offset))
                offset += m
                own[0] = (d, s + m, n - m)
                if m == n:
                    own.pop(0)
            sequence += 1


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` of each row, the ids as little-endian 16-bit numbers if all fit, else 32-bit ones, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], words.kind).tobytes()
        held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            ids = [x + end for x in words.raw([t for b in held for t in b.column(1).to_pylist()])]
            for b in held:
                own, ids = ids[: b.num_rows], ids[b.num_rows :]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["doc_id", "ids"])

        for batch in (b.slice(k, SENT) for b in batches for k in range(0, b.num_rows, SENT)):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= CHUNK:
                yield from done()
                held, size = [], 0
        yield from done()

    return common.written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary"), "ids")


def id_type(path: str) -> str:
    return encoder(path).kind


def corpus_statistics(rows: DataFrame, kind: str) -> Statistics:
    """Counted over all rows of ``ids``; what reaches the driver is a row for each token of the vocabulary, and two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, SENT):
                own = [np.frombuffer(x, kind) for x in batch.column(0).slice(k, SENT).to_pylist()]
                n, total = n + len(own), total + sum(map(len, own))
                # a token counts once a document
                more = np.bincount(distinct(own)[0], minlength=len(df))
                more[: len(df)] += df
                df = more
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [n, total]]))], ["token", "n"])

    counts = rows.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r.token: r.n for r in counts.collect()}
    df = np.zeros(max(found, default=0) + 1, np.int64)
    for token, n in found.items():
        if token >= 0:
            df[token] = n
    n = found.get(-1, 0)
    return Statistics(n, found.get(-2, 0) / max(1, n), df)


def dealt(rows: DataFrame, statistics: Statistics, kind: str) -> DataFrame:
    """Rows in ranges of their rarest term that another document has (-1: none); many documents of one term spread by their ids."""
    rarity = statistics.rarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for x in batch.column(1).to_pylist():
                ids = np.frombuffer(x, kind)
                t = int(ids[rarity[ids].argmax()])
                terms.append(t if rarity[t] > 0 else -1)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), batch.column(0), batch.column(1)], ["term", "doc_id", "ids"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.mapInArrow(run, f"term int, doc_id {dict(rows.dtypes)['doc_id']}, ids binary").withColumn("part", F.spark_partition_id())
    return keyed.repartitionByRange(parts, "term", "doc_id", "part").sortWithinPartitions("term", "doc_id").select("doc_id", "ids")


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack the column ``text`` of ``docs`` into sequences of at most ``window`` tokens.

    Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A document's tokens are those of its whole text and ``end_id``; null and empty texts have that one
    alone. Documents longer than a window fill windows of their own and go on in the next. Repeated rows
    are packed as often as they occur, rows without an id too; other columns are dropped, an empty table gives no rows. A shard
    never crosses a partition; sequence numbers hold the partition in their upper half.
    """
    kind = id_type(path)
    rows = encoded(docs, path, end_id)
    statistics = corpus_statistics(rows, kind)

    def packed(ids_of: list[object], raw: list[bytes], first: int, id_kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
        documents = [np.frombuffer(x, kind) for x in raw]
        pieces = pack_shard(documents, window, statistics)
        at = np.array(pieces, np.int64).reshape(-1, 5)
        wide = [x.astype("<u4").tobytes() for x in documents]
        crc = [zlib.crc32(memoryview(wide[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
        columns = [
            pa.array([ids_of[d] for d in at[:, 0]], id_kind), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(crc, pa.int64()),
            pa.array([len(documents[d]) for d in at[:, 0]], pa.int64()), pa.array(at[:, 3] + first), pa.array(at[:, 4]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), int(at[-1, 3]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids_of, raw, held, id_kind = [], [], 0, pa.int64()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids_of.append(key)
                raw.append(ids)
                held += len(ids) // np.dtype(kind).itemsize
                if held >= shard_tokens:
                    out, n = packed(ids_of, raw, first, id_kind)
                    yield out
                    ids_of, raw, held, first = [], [], 0, first + n
        if raw:
            yield packed(ids_of, raw, first, id_kind)[0]

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt(rows, statistics, kind).mapInArrow(run, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
