"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel counts common subsequences of three characters, gaps and all: an occurrence that spans s
characters weighs DECAY^s, spans over SPAN are left out, and the kernel is normalised. Inserted or
dropped characters so leave most of a word's weight in place. Strings are a sentence's terms: its
words without marks, lower-cased, and runs of single letters joined. A sentence is as toxic as its
worst term and a document as its worst sentence.

Training takes the distinct sentences of a bounded sample of labelled documents. Terms that occur in
toxic sentences more often than chance allows are the positive examples, terms of clean ones the
negative. Landmarks are drawn from both; in their Nyström space a squared-hinge SVM is solved by Newton steps. As
kernel and SVM are linear in the landmarks' subsequence weights, the machine folds into one weight a subsequence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DECAY, SPAN = 0.6, 7
#: Labelled documents used for training at most, those with the smallest hashes of each class.
MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
#: Terms that reach the driver at most.
MOST_POSITIVE, MOST_NEGATIVE = 1_000, 30_000
#: Expected number of terms that pass for toxic by chance, and the share of a toxic term's sentences that may be clean.
CHANCE, TOLERATED = 0.5, 0.02
LANDMARKS = 480
#: Clean examples of each kind: frequent, drawn at random and hard.
PLAIN = 5_000
#: Weight of an error, and Newton steps at most.
PENALTY, STEPS = 10.0, 50
#: Rows of a kernel, and terms to decide or rows to sum up, that the driver holds at once while it trains.
ROWS, BLOCK = 128, 1024
#: Longest term that is scored as one; longer ones are scored by overlapping parts.
LONGEST = 40
#: Words remembered by a worker; once as many are known no more are added.
REMEMBERED = 300_000

CLASSES = 64
_CODES = {c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß")}
_DIGIT, _OTHER, _EDGE = 60, 61, 62
_SENTENCES = re.compile(r"[.!?]+\s+|\n").split
_MARKS = re.compile(r"[\W_]+").sub
_SPELT = re.compile(r"(?<!\S)(?:\w\W{1,2}){2,}\w(?!\w)").findall


def term_of(word: str) -> str:
    return _MARKS("", word.lower())


def spelt(text: str) -> list[str]:
    """Runs of at least three single letters with blanks or marks between them, joined."""
    return [term_of(x) for x in _SPELT(text)]


def _codes(term: str) -> list[int]:
    return [_EDGE, *(_CODES.get(c) or (_DIGIT if c.isdigit() else _OTHER) for c in term), _EDGE]


_OFFSETS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _offsets(n: int):
    """Positions of all three-character subsequences of n characters within the span, and their weights."""
    if n not in _OFFSETS:
        at = np.array([(i, i + j, i + k) for i in range(n) for j, k in combinations(range(1, SPAN), 2) if i + k < n], np.int64).reshape(-1, 3)
        _OFFSETS[n] = at[:, 0], at[:, 1], at[:, 2], DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return _OFFSETS[n]


def subsequences(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, subsequence numbers and normalised weights of terms of at most ``LONGEST`` characters."""
    rows, columns, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(terms):
        by_length.setdefault(len(t), []).append(i)
    for length, members in by_length.items():
        codes = np.array([_codes(terms[i]) for i in members], np.int64)
        a, b, c, weight = _offsets(length + 2)
        if not len(a):
            continue
        number = (codes[:, a] * CLASSES + codes[:, b]) * CLASSES + codes[:, c]
        order = np.argsort(number, axis=1, kind="stable")
        number, weight = np.take_along_axis(number, order, 1), weight[order]
        first = np.ones(number.shape, bool)
        first[:, 1:] = number[:, 1:] != number[:, :-1]
        flat = np.flatnonzero(first.ravel())
        summed = np.add.reduceat(weight.ravel(), flat)
        row = flat // number.shape[1]
        norm = np.sqrt(np.bincount(row, summed**2, len(members)))
        rows.append(np.array(members)[row])
        columns.append(number.ravel()[flat])
        values.append(summed / norm[row])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def parts_of(term: str) -> list[str]:
    if len(term) <= LONGEST:
        return [term]
    return [term[k : k + LONGEST] for k in range(0, len(term) - LONGEST // 2, LONGEST // 2)]


class Machine:
    """A trained machine: a weight for each subsequence, and how a document's worst term becomes a score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, middle: float):
        self.weights, self.bias, self.slope, self.middle = weights, bias, slope, middle
        self.known: dict[str, float] = {}

    def decide(self, terms: list[str]) -> np.ndarray:
        """The machine's decision for each term; that of a long one is its worst part's."""
        parts = [(i, p) for i, t in enumerate(terms) for p in parts_of(t)]
        rows, columns, values = subsequences([p for _, p in parts])
        each = np.bincount(rows, values * self.weights[columns], len(parts)) + self.bias
        out = np.full(len(terms), -np.inf)
        np.maximum.at(out, np.array([i for i, _ in parts], np.int64), each)
        return out

    def worst(self, texts: list[str | None]) -> list[float]:
        """The decision for each text's worst term; that for an empty term where it has none."""
        known, split, new = self.known, [], set()
        for text in texts:
            words = (text or "").split()
            found = list(map(known.get, words))
            try:
                top = max(found, default=self.bias)
            except TypeError:  # a word is not known
                top = None
            if top is None:
                new.update([w for w, x in zip(words, found) if x is None])
            split.append((top, words, found))
        new = list(new)
        terms: dict[str, float] = {}
        distinct = list({term_of(w) for w in new})
        for k in range(0, len(distinct), 2048):
            part = distinct[k : k + 2048]
            terms.update(zip(part, self.decide(part).tolist()))
        fresh = {w: terms[term_of(w)] for w in new}
        if len(known) < REMEMBERED:
            known.update(fresh)
        out = []
        for text, (top, words, found) in zip(texts, split):
            if top is None:
                top = max([fresh[w] if x is None else x for w, x in zip(words, found)])
            joined = spelt(text) if text else []
            out.append(max(top, float(self.decide(joined).max())) if joined else top)
        return out

    def score(self, worst: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * (worst - self.middle)))))


def _kernel_rows(a: list[str], b: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Normalised kernel of each string of ``a`` with each of ``b``, a few rows at a time with the place of the first."""
    rows, columns, values = subsequences(b)
    distinct, at = np.unique(columns, return_inverse=True)
    dense = np.zeros((len(b), len(distinct)))
    dense[rows, at] = values
    for k in range(0, len(a), ROWS):
        rows, columns, values = subsequences(a[k : k + ROWS])
        where = np.searchsorted(distinct, columns)
        fits = (where < len(distinct)) & (distinct[np.minimum(where, len(distinct) - 1)] == columns) if len(distinct) else np.zeros(len(columns), bool)
        own = np.zeros((min(ROWS, len(a) - k), len(distinct)))
        own[rows[fits], where[fits]] = values[fits]
        yield k, own @ dense.T


def _kernel(a: list[str], b: list[str]) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(b))), *(part for _, part in _kernel_rows(a, b))])


def _newton(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge SVM: Newton steps until the set of margin errors settles. The last column of ``z`` is one; its weight, the bias, is hardly penalised."""
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    w, errors = np.zeros(z.shape[1]), np.ones(len(z), bool)
    for _ in range(STEPS):
        left, right = ridge.copy(), np.zeros(len(ridge))
        for k in range(0, len(z), BLOCK):
            part = slice(k, k + BLOCK)
            on = errors[part]
            zs = z[part][on]
            costly = (zs * cost[part][on][:, None]).T
            left += costly @ zs
            right += costly @ y[part][on]
        w = np.linalg.solve(left, right)
        now = y * (z @ w) < 1
        if (now == errors).all():
            break
        errors = now
    return w


def fit(positive: list[str], negative: list[str], hard: list[str]) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of the machine that tells ``positive`` from ``negative`` and ``hard`` terms."""
    positive, negative, hard = ([p for t in terms for p in parts_of(t)] for terms in (positive, negative, hard))

    def spread(terms: list[str], n: int) -> list[str]:
        return terms[:: max(1, -(-len(terms) // n))]

    marks = list(dict.fromkeys(positive[: LANDMARKS // 2] + spread(negative, LANDMARKS // 4) + spread(hard, LANDMARKS // 4)))
    negative = negative + hard
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    good = values > 1e-8 * max(values.max(initial=0), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.ones((len(positive) + len(negative), root.shape[1] + 1))
    for k, part in _kernel_rows(positive + negative, marks):
        z[k : k + ROWS, :-1] = part @ root
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.where(y > 0, PENALTY / max(1, len(positive)), PENALTY / max(1, len(negative))) * len(y) / 2
    w = _newton(z, y, cost)
    beta = root @ w[:-1]
    rows, columns, values = subsequences(marks)
    return np.bincount(columns, values * beta[rows], CLASSES**3), float(w[-1])


def in_fold(doc_id: str, fold: int = 0, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``MOST_TOXIC`` and ``MOST_CLEAN`` documents outside the held-out fold."""
    usable = labels.where(~in_fold("doc_id")).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the two limits
    return common.written(docs.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL"), "labelled")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each sentence: the term, the sentence's two longest other terms hashed, the label."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        terms_, keys, labels = [], [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for sentence in _SENTENCES(text):
                terms = {term_of(w) for w in sentence.split()} | set(spelt(sentence))
                terms.discard("")
                longest = sorted(terms, key=lambda t: (-len(t), t))[:3]
                for t in terms:
                    terms_.append(t)
                    keys.append(xxh64_intdigest(" ".join([x for x in longest if x != t][:2])) >> 1)
                    labels.append(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(terms_, pa.string()), pa.array(keys, pa.int64()), pa.array(labels, pa.int32())], ["term", "key", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Train from ``labels (doc_id, toxic)``; the held-out fold is never used. Without a toxic term nothing is toxic."""
    sample = training_sample(docs, labels)
    seen = sample.select("text", "toxic").mapInArrow(_occurrences, "term string, key long, toxic int")
    # copies of a sentence, edited ones too, count once; one that a clean document has too is clean
    distinct = seen.groupBy("term", "key").agg(F.min("toxic").alias("toxic"))
    counts = common.written(distinct.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "terms")
    total = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("*").alias("n")).first()
    share = max(total.bad, 1) / max(total.bad + total.good, 1)
    needed = math.ceil(math.log(CHANCE / max(total.n, 1)) / math.log(share)) if 0 < share < 1 else math.inf
    if needed == math.inf or needed < 1:
        return Machine(np.zeros(CLASSES**3), -1.0, 4.0, 0.0)
    toxic = counts.where((F.col("bad") >= needed) & (F.col("good") <= TOLERATED * F.col("bad")))
    positive = [r.term for r in toxic.orderBy(F.desc("bad"), "term").limit(MOST_POSITIVE).collect()]
    if not positive:
        return Machine(np.zeros(CLASSES**3), -1.0, 4.0, 0.0)
    clean = counts.where("good > 0").join(F.broadcast(counts.sparkSession.createDataFrame([(t,) for t in positive], "term string")), "term", "left_anti")
    often = [r.term for r in clean.orderBy(F.desc("good"), "term").limit(MOST_NEGATIVE // 3).collect()]
    drawn = [r.term for r in clean.orderBy(F.xxhash64("term"), "term").limit(MOST_NEGATIVE * 2 // 3).collect()]
    # the clean terms that the first machine takes for worst join the second's examples and landmarks
    plain, pool = often[:PLAIN] + drawn[:PLAIN], list(dict.fromkeys(often[PLAIN:] + drawn[PLAIN:]))
    weights, bias = fit(positive, plain, [])
    machine = Machine(weights, bias, 1.0, 0.0)
    decided = np.concatenate([np.zeros(0), *(machine.decide(pool[k : k + BLOCK]) for k in range(0, len(pool), BLOCK))])
    worst = np.argsort(-decided, kind="stable")[:PLAIN]
    weights, bias = fit(positive, plain, [pool[i] for i in worst])
    common.give_back()
    return calibrated(Machine(weights, bias, 1.0, 0.0), sample)


def calibrated(machine: Machine, sample: DataFrame) -> Machine:
    """The machine with the cutoff between clean and toxic documents of the sample, in the middle of the widest gap among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(machine.worst(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], ["worst", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "worst double, toxic int").collect()  # bounded by the sample
    machine.known.clear()
    worst, y = np.array([r.worst for r in rows]), np.array([r.toxic for r in rows])
    order = np.argsort(worst, kind="stable")
    worst, y = worst[order], y[order]
    n_bad, n_good = max(1, y.sum()), max(1, len(y) - y.sum())
    # cutting before place k: share of toxic ones missed and twice that of clean ones flagged
    loss = np.concatenate([[0], np.cumsum(y)]) / n_bad + 2 * (n_good - np.concatenate([[0], np.cumsum(1 - y)])) / n_good
    edges = np.concatenate([[worst[0] - 1], (worst[1:] + worst[:-1]) / 2, [worst[-1] + 1]])
    gaps = np.concatenate([[1.0], np.diff(worst), [1.0]])
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    k = best[np.argmax(gaps[best])]
    return Machine(machine.weights, machine.bias, 4.0, float(edges[k]))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``; null and empty texts score as an empty term does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            scores = [machine.score(x) for k in range(0, batch.num_rows, 128) for x in machine.worst(texts.slice(k, 128).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, machine: Machine, cutoff: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores below ``cutoff``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # small batches go out, as texts go along
                part = batch.slice(k, 512)
                texts = part.column(at)
                clean = [machine.score(x) < cutoff for j in range(0, part.num_rows, 128) for x in machine.worst(texts.slice(j, 128).to_pylist())]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs (doc_id, text)``.

    Only the text enters a score. Repeated rows give repeated results, other columns are ignored, an
    empty table gives no rows. A document with several labels is toxic if one says so; labels of unknown
    documents, null labels and held-out ones (crc32 of the id as text divisible by five) are left out.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
