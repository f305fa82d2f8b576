"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained by Spark ML from labelled urls, which a documented generator makes where no table
has any, and then written out as one SQL expression, so that scoring is generated code. DataFrame and
SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Verdict and rule: a host, which stands for its subdomains too, and how the path must start.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
TREES, DEPTH, STEP, SEED = 16, 4, 0.3, 7
#: Labelled urls taken for training at most, those with the smallest hashes.
MOST_LABELLED = 20_000
#: Pseudo-counts of a suffix's block rate.
PRIOR = 4.0
#: Labels that with a country's label after them make one public suffix.
SECOND_LEVEL = "co|com|org|net|gov|ac|edu"
#: Urls that the generator labels, of each label half; one in FOLDS is held out for tests.
GENERATED, FOLDS = 8_000, 5


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column; both are empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule, or null. Rules are a short list that a person keeps; they become one CASE."""
    found = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


FEATURES = (
    "length", "host_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "params", "query_length", "longest_label", "longest_segment",
    "suffix_rate", "suffix_count",
)
#: What the features tell of, for tests: trees have to use most of these.
FAMILIES = {
    "length": ("length", "host_length", "query_length", "longest_label", "longest_segment"), "depth": ("depth", "labels"), "digits": ("digit_ratio", "host_digits"),
    "hyphens": ("hyphens",), "entropy": ("entropy",), "parameters": ("params",), "suffix": ("suffix_rate", "suffix_count"),
}


def suffix_of(host: Column) -> Column:
    """The public suffix by rule: the last label, or the last two where a country's follows one of ``SECOND_LEVEL``."""
    return F.regexp_extract(host, rf"(?:^|\.)((?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]*))$", 1)


def with_features(urls: DataFrame, suffixes: dict[str, tuple[float, int]], base_rate: float) -> DataFrame:
    """``urls`` (with ``url, host, path``) and the lexical features, all doubles; a null url counts as empty."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    length = F.char_length(host)
    share = lambda c: (length - F.char_length(F.replace(host, c, F.lit("")))) / length
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(host, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    parts = lambda text, mark: F.filter(F.split(text, mark), lambda x: x != "")
    longest = lambda text, mark: F.array_max(F.transform(F.split(text, mark), lambda x: F.char_length(x)))
    digits = lambda text: F.when(F.char_length(text) > 0, F.regexp_count(text, F.lit("[0-9]")) / F.char_length(text)).otherwise(0.0)
    suffix = suffix_of(host)
    rate, count = F.lit(base_rate), F.lit(0.0)
    for name, (r, n) in suffixes.items():
        rate = F.when(suffix == name, F.lit(r)).otherwise(rate)
        count = F.when(suffix == name, F.lit(float(n))).otherwise(count)
    made = {
        "length": F.char_length(url),
        "host_length": length,
        "labels": F.size(parts(host, r"\.")),
        "depth": F.size(parts(path, "/")),
        "digit_ratio": digits(url),
        "host_digits": digits(host),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "params": F.size(parts(query, "&")),
        "query_length": F.char_length(query),
        "longest_label": longest(host, r"\."),
        "longest_segment": longest(path, "/"),
        "suffix_rate": rate,
        "suffix_count": count,
    }
    return urls.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()})


class UrlModel:
    """Boosted trees as a SQL expression over the feature columns, with the suffix statistics they were trained on.

    ``fitted`` is the model that the expression was written from.
    """

    def __init__(self, score_sql: str, suffixes: dict[str, tuple[float, int]], base_rate: float, fitted=None):
        self.score_sql, self.suffixes, self.base_rate, self.fitted = score_sql, suffixes, base_rate, fitted

    def score(self, urls: DataFrame, name: str = "score") -> DataFrame:
        """``urls`` (with ``url, host, path``) and the probability that each is to be blocked."""
        scored = with_features(urls, self.suffixes, self.base_rate).withColumn(name, F.expr(self.score_sql))
        return scored.drop(*(f"f_{k}" for k in FEATURES))


def _tree_sql(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN f_{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def train(labelled: DataFrame) -> UrlModel:
    """Train from ``url, label`` (1: block). Null labels and urls are left out; of more than
    ``MOST_LABELLED`` rows those with the smallest hashes are taken. Both labels must occur."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    host, path = host_and_path()
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("url IS NOT NULL AND label IS NOT NULL")
    rows = common.written(rows.orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED).withColumns({"host": host, "path": path}).coalesce(1), "labelled")
    counts = rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("label").alias("bad"), F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(100).collect()
    total = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    if not total.n or not 0 < total.bad < total.n:
        raise ValueError("both labels must occur")
    base = total.bad / total.n
    suffixes = {r.suffix: ((r.bad + PRIOR * base) / (r.n + PRIOR), r.n) for r in counts}
    vectors = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(rows, suffixes, base))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, cacheNodeIds=False).fit(vectors.select("features", "label"))
    trees = list(model._java_obj.trees())
    margin = " + ".join(f"{float(w)!r}D * ({_tree_sql(t.rootNode())})" for w, t in zip(model.treeWeights, trees))
    return UrlModel(f"1.0D / (1.0D + exp(-2.0D * ({margin})))", suffixes, base, model)


#: The generator's syllables, and its shares for urls to be allowed and to be blocked. Every share is above zero for both.
SYLLABLES = "ba be bi co da de en fo ga he in ka lo ma ne on pa re sa ta ti ul vo we".split()
SUFFIXES = (("com", 0.46, 0.40), ("net", 0.16, 0.15), ("org", 0.18, 0.10), ("de", 0.06, 0.03), ("co.uk", 0.06, 0.04), ("info", 0.05, 0.10), ("xyz", 0.02, 0.10), ("top", 0.01, 0.08))
SHARES = {
    "hyphen": (0.06, 0.70), "second_hyphen": (0.15, 0.40), "random_host": (0.03, 0.20), "host_digits": (0.06, 0.25), "more_labels": (0.10, 0.30),
    "deep": (0.25, 0.50), "long_number": (0.10, 0.40), "query": (0.35, 0.55), "more_params": (0.20, 0.50), "long_value": (0.10, 0.40),
}


def generated_urls(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """``n`` labelled urls, as no table labels any: ``url, label`` (1: block).

    Unwanted urls are made as such urls tend to be: hosts of several words with hyphens or of random characters and digits, more
    labels, rarer suffixes, deeper paths, long numbers and many parameters. Each of these traits occurs with both labels, in the
    shares of ``SHARES`` and ``SUFFIXES``, so no trait alone decides. Hosts are made of syllables or random characters, and no table
    is looked at. The same ``n`` gives the same urls.
    """
    rows = spark.range(0, n, 1, 4).withColumn("label", (F.col("id") % 2).cast("int"))
    bad = F.col("label") == 1

    def draw(name: str, *more) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(name), *more), F.lit(1_000_000))

    def has(name: str) -> Column:
        good_share, bad_share = SHARES[name]
        return draw(name) < F.when(bad, int(bad_share * 1_000_000)).otherwise(int(good_share * 1_000_000))

    def picked(values: list[str], name: str, *more) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (draw(name, *more) % len(values) + 1).cast("int"))

    def word(name: str, least: int, most: int) -> Column:
        size = draw(name + "#") % (most - least + 1) + least
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: picked(SYLLABLES, name, i)), "")

    def characters(name: str, alphabet: str, least: int, most: int) -> Column:
        size = draw(name + "#") % (most - least + 1) + least
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: picked(list(alphabet), name, i)), "")

    def when(condition: Column, value: Column, other="") -> Column:
        return F.when(condition, value).otherwise(other if isinstance(other, Column) else F.lit(other))

    worded = F.concat(word("a", 2, 4), when(has("hyphen"), F.concat(F.lit("-"), word("b", 1, 3), when(has("second_hyphen"), F.concat(F.lit("-"), word("c", 1, 2))))))
    name = when(has("random_host"), characters("h", "abcdefghijklmnopqrstuvwxyz0123456789", 8, 20), worded)
    name = F.concat(name, when(has("host_digits"), characters("d", "0123456789", 1, 4)))
    front = F.concat(picked(["", "", "www.", "m.", "blog."], "front"), when(has("more_labels"), F.concat(word("e", 1, 3), F.lit("."))))
    at, suffix = draw("suffix"), F.lit(SUFFIXES[0][0])
    for k in range(1, len(SUFFIXES)):
        below = [int(1_000_000 * sum(x[i] for x in SUFFIXES[:k])) for i in (1, 2)]
        suffix = F.when(at >= F.when(bad, below[1]).otherwise(below[0]), F.lit(SUFFIXES[k][0])).otherwise(suffix)
    deep = when(has("deep"), F.concat(word("f", 1, 3), F.lit("/"), when(draw("g") % 2 == 0, F.concat(word("g", 1, 3), F.lit("/")))))
    number = characters("n", "0123456789", 1, 4)
    path = F.concat(F.lit("/"), picked(["", "en/", "de/", "fr/", "es/", "news/"], "top"), deep, number, when(has("long_number"), characters("m", "0123456789", 3, 6)), picked(["", "", "", "/", ".html", ".php"], "end"))
    value = lambda k: F.concat(characters(k, "abcdefghijklmnopqrstuvwxyz0123456789", 1, 4), when(has("long_value"), characters(k + "x", "abcdefghijklmnopqrstuvwxyz0123456789", 6, 16)))
    more = when(has("more_params"), F.concat(F.lit("&ref="), value("q"), when(draw("r") % 2 == 0, F.concat(F.lit("&aff="), value("r")))))
    query = when(has("query"), F.concat(F.lit("?"), picked(["page=", "id=", "utm_source=", "q="], "p"), value("p"), more))
    url = F.concat(picked(["http://", "https://"], "scheme"), front, name, F.lit("."), suffix, path, query, picked(["", "", "", "", "", "#top"], "mark"))
    return rows.select(url.alias("url"), "label")


def held_out(url: str = "url") -> Column:
    """Whether a labelled url is left out of training: one in ``FOLDS``, by its hash."""
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)) == 0


_trained: list[UrlModel] = []


def trained(spark: SparkSession) -> UrlModel:
    """The model of the registered query, from the generated urls that are not held out; as these are fixed, a driver trains it once."""
    if not _trained:
        _trained.append(train(generated_urls(spark).where(~held_out())))
    return _trained[0]


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, cutoff: float = 0.5) -> DataFrame:
    """``pages`` (with ``page_id, url``) judged: ``page_id, host, path, rule, verdict, score``.

    A rule's verdict stands; else the url is blocked if its score reaches ``cutoff``. Null urls and those
    without ``://`` have empty host and path, fit no rule and are scored as they are. Repeated rows give
    repeated results; other columns are dropped; an empty table gives no rows.
    """
    host, path = host_and_path()
    urls = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    scored = model.score(urls).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit("")))
    verdict = by_rule.when(F.col("score") >= cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"), trained(spark))
