"""Byte-level BPE by a sentencepiece model that is written, not trained.

The vocabulary of a rank file becomes a sentencepiece BPE model: each token's bytes are mapped to
printable characters one by one, its score is the negative rank and its id the rank. Normalisation
is the identity. Merging the adjacent pair with the best score, leftmost first, is then what the
ranks ask for. Each pre-token is encoded on its own; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: White space as Unicode's White_Space property has it, which Python's ``\s`` exceeds by four control characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks, and beside them pre-tokens, remembered by a worker; once as many are known no more are added.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it is printable Latin-1, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary, ids equal to ranks; the unknown piece follows the last rank.

    Ranks must be 0 to n-1 and include every single byte.
    """
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n-1 and cover all single bytes")
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2  # piece types; model type
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(shown[b] for b in token).encode()
        pieces[rank] = _block(1, _block(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, normal))
    tail = _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + tail + _block(2, trainer) + _block(3, normaliser)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes texts to ids and ids to bytes. ``pattern`` splits a text into pre-tokens."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex
        import sentencepiece

        ranks = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.shown = {chr(b): c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {str(i): bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))}
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pretokens = regex.compile(white).findall
        self.edge = regex.compile(f"^[{WHITE}]|[{WHITE}]$").search
        self.table = str.maketrans(self.shown)
        self.remembered = remembered
        self.words: dict[str, str | None] = {}
        self.chunks: dict[str, str | None] = {}

    def _encode_words(self, words: list[str]) -> list[str]:
        """Ids of pre-tokens, as decimal numbers joined by spaces."""
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in words]
        return [" ".join(map(str, ids)) for ids in self.model.encode(mapped, num_threads=1)]  # threads cost more than words

    def _learn(self, chunks: list[str]) -> dict[str, str | None]:
        """Ids of chunks that were not remembered; None for one that white space ties to its neighbours."""
        split = {c: None if not c or self.edge(c[1:] if c[0] == " " else c) or c == " " else self.pretokens(c) for c in chunks}
        new = list(dict.fromkeys(w for ws in split.values() if ws for w in ws if w not in self.words))
        found = dict(zip(new, self._encode_words(new))) if new else {}
        known = self.words
        out = {c: None if ws is None else " ".join([found[w] if w in found else known[w] for w in ws]) for c, ws in split.items()}
        if len(known) < self.remembered:
            known.update(found)
        return out

    def encode(self, text: str) -> str:
        """Ids of ``text`` in decimal, joined by spaces.

        A single space before a word belongs to the word's pre-token, so what stands between single
        spaces is split and encoded on its own, and remembered. Where white space is longer the whole text is split at once.
        """
        if not text:
            return ""
        first, *rest = text.split(" ")
        parts = ([first] if first else []) + [" " + x for x in rest]
        known = self.chunks
        found = [known.get(x, 0) for x in parts]
        if 0 in found:
            learnt = self._learn(list(dict.fromkeys(x for x, y in zip(parts, found) if y == 0)))
            found = [learnt[x] if y == 0 else y for x, y in zip(parts, found)]
            if len(known) < self.remembered:
                known.update(learnt)
        if None in found or not first:
            words = self.pretokens(text)
            return " ".join(self._encode_words(words))
        return " ".join(found)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode the column ``text`` of ``docs`` and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``keep_ids``, ``ids`` (array of
    int) and ``decoded`` (binary). Null texts count as empty: no ids, no bytes. Repeated rows give
    repeated results, other columns are dropped, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, bytes_sha, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                raw = coder.decode(ids)
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    all_ids.append([int(x) for x in ids.split(" ")] if ids else [])
                    decoded.append(raw)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded binary" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
