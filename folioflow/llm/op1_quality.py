"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document that passed the base when one of its measures reaches a cutoff. The trials are
distinct labelled texts that pass the base, so copies and repeated labels count once. For each stratum,
one half of them proposes a cutoff for each measure, where it pays; the other half, the holdout, certifies:
the exact (Clopper-Pearson) upper bound on the share of good texts that the stratum's rules reject together
has to stay within the allowed one. The rules are tried in the order of their gain, first one, then two and
so on, until a set fails (fixed-sequence testing, which spends no error on the trials that pass); the error
is shared out (Bonferroni) among the strata whose holdout could certify anything, which its size alone
decides. A stratum where nothing can be certified, as where few labels are, rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of good documents of a stratum that its rules together may reject, and the chance that this fails somewhere.
ALPHA, DELTA = 0.02, 0.05
#: Measures are counted in so many steps from 0 to 1; cutoffs are their edges.
STEPS = 100
#: What rejecting a good document costs against the gain of a bad one.
COST = 20.0
#: Marks beyond plain punctuation, and all ASCII characters that are no letters.
MARKS = "!?#*$%&|<>^~=+@"
NOT_LETTERS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())
MEASURES = ("symbols", "upper", "repeated", "punctuation")


def _measures(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, letters, upper-case letters, other marks."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, common.BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(common.BLANK)]
    doubled = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count: dict[tuple, int] = {}
            for w in windows:
                count[w] = count.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    lower, upper = text.lower(), text.upper()
    if len(lower) == len(text) == len(upper):
        cased = sum(map(str.__ne__, lower, upper)) if not text.isascii() else len(text) - sum(map(text.count, NOT_LETTERS))
        high = sum(map(str.__ne__, lower, text))
    else:
        cased, high = sum(c.isupper() or c.islower() for c in text), sum(c.isupper() for c in text)
    marks = sum(map(text.count, MARKS))
    return len(words), chars, symbols, doubled, repeated, cased, high, marks


def measured(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, columns ``more``, the base counts and a share from 0 to 1 for each of ``MEASURES``; a null text has no words."""

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = [[] for _ in names], [[] for _ in MEASURES]
            for text in batch.column(0).to_pylist():
                *base, letters, upper, marks = _measures(text or "")
                n_words, chars, symbols, _, repeated = base
                for column, value in zip(counts, base):
                    column.append(value)
                for column, value in zip(shares, (symbols / max(1, chars), upper / max(1, letters), repeated / max(1, n_words), marks / max(1, chars))):
                    column.append(min(1.0, value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.float64()) for c in shares)],
                [*batch.schema.names[1:], *names, *(f"m_{m}" for m in MEASURES)],
            )

    kept = ["doc_id", *more]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), *(f"{c} long" for c in names), *(f"m_{m} double" for m in MEASURES)])
    return docs.select("text", *kept).mapInArrow(run, schema)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """Logarithm of P(X <= k) for X binomial (n, p)."""
    if k >= n or p <= 0:
        return 0.0
    if p >= 1:
        return -math.inf
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def certified(k: int, n: int, share: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, on a share of which k of n were seen stays within ``share``."""
    return n > 0 and k < n and k <= share * n and log_binomial_cdf(k, n, share) <= math.log(delta)


class Cutoff(NamedTuple):
    """A rule: documents of the stratum with a measure of at least ``cutoff`` are rejected."""

    stratum: str | None
    measure: str
    cutoff: float


def _half() -> Column:
    """0 for texts that propose, 1 for the holdout; copies of a text are in one half."""
    return F.pmod(F.xxhash64(F.lit(5), F.col("text_key")), F.lit(2))


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def trials(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, text_key, quality`` and the measures of each distinct labelled text that passes the base; good if one label says so."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    labelled = rows.where(~failed_base()).join(known, "doc_id")
    measures = [f"m_{m}" for m in MEASURES]
    return labelled.groupBy("stratum", "text_key").agg(F.max("quality").alias("quality"), *(F.max(m).alias(m) for m in measures))


def propose(labelled: DataFrame) -> dict[str | None, list[Cutoff]]:
    """For each stratum a cutoff by measure from the proposing half, where it pays, those of most gain first.

    What reaches the driver are counts: strata times measures times steps.
    """
    steps = F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(f"m_{m}") * STEPS).cast("int").alias("step")) for m in MEASURES))
    rows = (
        labelled.where(_half() == 0)
        .select("stratum", "quality", F.explode(steps).alias("s"))
        .groupBy("stratum", "quality", "s.measure", "s.step")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    table: dict[tuple, list[int]] = {}
    for r in rows:
        table.setdefault((r.stratum, r.measure, r.quality), [0] * (STEPS + 1))[r.step] += r.n
    none, found = [0] * (STEPS + 1), {}
    for stratum in {k[0] for k in table}:
        gains = []
        for measure in MEASURES:
            bad, good = (table.get((stratum, measure, q), none) for q in (0, 1))
            gain = {c: sum(bad[c:]) - COST * sum(good[c:]) for c in range(1, STEPS + 1)}
            # cutoffs of equal gain bound an empty stretch; its middle is farthest from either side
            best = sorted(c for c in gain if gain[c] == max(gain.values()))
            if gain[best[0]] > 0:
                gains.append((gain[best[0]], Cutoff(stratum, measure, best[len(best) // 2] / STEPS)))
        found[stratum] = [c for _, c in sorted(gains, key=lambda x: (-x[0], x[1].measure))]
    return found


def shared_error(sizes: list[int], alpha: float, delta: float) -> float:
    """The error of each stratum: that of the most strata whose holdouts, of these sizes, can all certify a rule without a hit."""
    for m in range(len(sizes), 1, -1):
        if sum(certified(0, n, alpha, delta / m) for n in sizes) >= m:
            return delta / m
    return delta


def select_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[Cutoff]:
    """Certified cutoffs from the ``trials``."""
    labelled = common.written(labelled, "trials")
    proposed = propose(labelled)
    # trial j takes the j + 1 rules of most gain
    sets = [[c for rules in proposed.values() for c in rules[: j + 1]] for j in range(len(MEASURES))]
    hits = [rejected(cutoffs, F.col("stratum")) for cutoffs in sets]
    good = F.col("quality") == 1
    held = labelled.where(_half() == 1).groupBy("stratum").agg(F.count_if(good).alias("n"), *(F.count_if(good & hit).alias(f"k{j}") for j, hit in enumerate(hits)))
    held = [r for r in held.collect() if proposed.get(r.stratum)]
    # as many strata may be able to certify as share the error; a larger stratum goes first where not all are
    error, found = shared_error([r.n for r in held], alpha, delta), []
    share = round(delta / error)
    for r in sorted(held, key=lambda r: (-r.n, str(r.stratum)))[:share]:
        rules, passed = proposed[r.stratum], 0
        while passed < len(rules) and certified(r[f"k{passed}"], r.n, alpha, error):
            passed += 1
        found += rules[:passed]
    return found


def rejected(cutoffs: list[Cutoff], stratum: Column) -> Column:
    """Whether one of the rules of its stratum rejects a document."""
    out = F.lit(False)
    for c in cutoffs:
        out = out | (stratum.eqNullSafe(F.lit(c.stratum)) & (F.floor(F.col(f"m_{c.measure}") * STEPS) >= round(c.cutoff * STEPS)))
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs (doc_id, text, lang)`` judged: the base counts, ``base_failed`` and ``kept``.

    Strata are the values of ``lang``, null among them. ``labels (doc_id, quality)`` may lack documents; of several labels of a
    document, or of copies of a text, the best counts. A document fails the base with fewer
    than 50 words or over half of its words in repeated windows; then it is not kept. Null and empty
    texts have no words. Repeated rows give repeated results, other columns are ignored, an empty table
    gives no rows, and without labels all that pass the base are kept.
    """
    named = docs.select("doc_id", "text", F.col("lang").alias("stratum"), common.text_key().alias("text_key"))
    rows = common.written(measured(named, ("stratum", "text_key")), "measures")
    cutoffs = select_cutoffs(trials(rows, labels), alpha, delta)
    failed = failed_base()
    kept = ~failed & ~rejected(cutoffs, F.col("stratum"))
    base = [c for c in rows.columns if c.startswith("n_") or c == "word_chars"]
    return rows.select("doc_id", *base, failed.alias("base_failed"), kept.alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
