"""The supplier dimension: loading, exact and fuzzy joins, filling of gaps, and suppliers from paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import fields, taxid
from ..functions import text as T
from ..functions.nearest import Names
from ..session import settled


#: Names that ask a copy of a block's names at most, until there is a copy for each task.
NAMES_A_COPY = 1000


def prepared(raw: DataFrame, ordinal: str) -> DataFrame:
    """Rows of a supplier list with their keys, without empty ones, the first of each (name, identifier).

    ``raw`` has the list's own headers, which are found by their aliases; ``ordinal`` gives the order.
    """
    name_header, tax_header = (T.find_header([c for c in raw.columns if c != ordinal], a) for a in (V.VENDOR_HEADERS, V.TAX_HEADERS))
    if name_header is None and tax_header is None:
        raise ValueError("neither a supplier's name nor an identifier is among the headers")

    def value(header: str | None) -> Column:
        c = F.btrim(F.coalesce(F.col(f"`{header}`").cast("string"), F.lit(""))) if header else F.lit("")
        return F.when(F.lower(c) == "nan", F.lit("")).otherwise(c)

    rows = raw.select(F.col(ordinal).alias("id"), value(name_header).alias("vendor_name"), taxid.canonical(value(tax_header)).alias("rfc"))
    rows = rows.withColumn("vendor_name_normalized", fields.match_name(F.col("vendor_name")))
    rows = rows.withColumns({"vendor_name_core": fields.core_name(F.col("vendor_name_normalized")), "rfc_normalized": taxid.match_key(F.col("rfc"))})
    rows = rows.where("vendor_name_normalized <> '' OR rfc_normalized <> ''")
    first = rows.groupBy("vendor_name_normalized", "rfc_normalized").agg(F.min_by(F.struct(*rows.columns), "id").alias("r")).select("r.*")
    empty = ("vendor_name", "vendor_name_normalized", "vendor_name_core", "rfc_normalized")
    return first.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in empty})


def load_counts(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """How many rows were read, inserted and skipped."""
    return raw.agg(F.count("*").alias("rows_read")).crossJoin(loaded.agg(F.count("*").alias("rows_inserted"))).withColumn("rows_skipped", F.col("rows_read") - F.col("rows_inserted"))


def _first_by(vendors: DataFrame, key: str) -> DataFrame:
    """The first supplier of each key as a struct."""
    return vendors.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("k")).agg(F.min_by(F.struct("id", "vendor_name", "rfc"), "id").alias("v"))


def _gram_length(n: Column) -> Column:
    """The largest power of two that is at most half of ``n``."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 2)


def _contained(names: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of ``names (normal, core)`` and ``others (other, v)`` with other first words that may be similar enough.

    Without a common first word everything but containment adds up to 0.80, short of the least 0.82, so one name contains the other. It is
    then at least 0.76 as long, as both ratios are twice its length over both lengths; it leaves out less than a quarter of the longer one
    and so holds the gram in the middle of it. The longer side sends that gram, the shorter all of its own of the lengths that fit.
    """
    ratios = V.SIMILARITY["ratio"] + V.SIMILARITY["token_sort"]
    bound = (V.LEAST_SIMILARITY - V.SIMILARITY["token_set"] - V.SIMILARITY["contains"]) / ratios - 1e-9

    def middle(rows: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        q = _gram_length(n)
        return rows.where(n >= 4).withColumn("gram", F.substr(F.col(c), F.floor((n - q) / 2).cast("int") + 1, q))

    def grams(rows: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        lengths = F.array_distinct(F.array(_gram_length(n), _gram_length(F.floor(n * 1.32).cast("int"))))
        of = F.transform(lengths, lambda q: F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, q)))
        return rows.where(n >= 4).withColumn("gram", F.explode(F.array_distinct(F.flatten(of))))

    shorter, both = F.least(F.length("core"), F.length("other")), F.length("core") + F.length("other")
    columns = ("normal", "core", "other", "v")
    longer = middle(others, "other").join(grams(names, "core"), "gram").where(F.contains("other", "core") & (2 * shorter >= bound * both)).select(*columns)
    less = middle(names, "core").join(grams(others, "other"), "gram").where(F.contains("core", "other") & (2 * shorter >= bound * both)).select(*columns)
    return longer.unionByName(less)


def _nearest(open_: DataFrame, blocks: DataFrame) -> DataFrame:
    """``core, other, score``: of ``blocks (word, other)`` the most similar to each of ``open_ (word, core, least)`` with the same first word.

    A block's names are copied for every so many that ask, over no more tasks than a shuffle has; one block's names are held at once.
    """
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = open_.select("word", "core", "least").distinct()
    copies = asked.groupBy("word").agg(F.least(F.ceil(F.count("*") / NAMES_A_COPY), F.lit(parts)).cast("int").alias("copies"))
    listed = blocks.join(copies, "word").select("word", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("double").alias("least"), F.col("other").alias("name"))
    asking = asked.join(copies, "word").select("word", F.pmod(F.hash("core"), F.col("copies")).alias("copy"), "least", F.col("core").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, listed, names = None, [], None
        for batch in batches:
            found = []
            for word, copy, least, name in zip(*(c.to_pylist() for c in batch.columns)):
                if block != (word, copy):
                    block, listed, names = (word, copy), [], None
                if least is None:  # these come first
                    listed.append(name)
                else:
                    names = names or Names(listed)
                    found += [(name, *hit) for hit in names.nearest(name, least)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["core", "other", "score"])

    return listed.unionByName(asking).repartition(parts, "word", "copy").sortWithinPartitions("word", "copy", "least").mapInArrow(run, "core string, other string, score double")


def matched_by_name(names: DataFrame, vendors: DataFrame) -> DataFrame:
    """The supplier of each of ``names (key, name)``: ``key, vendor_id, vendor_name, rfc, score, strategy``; only those found."""
    return names.select("key", "name").join(matched_names(names, vendors), "name").select("key", "vendor_id", "vendor_name", "rfc", "score", "strategy")


def matched_names(names: DataFrame, vendors: DataFrame) -> DataFrame:
    """The supplier of each different one of ``names (name)``: ``name, vendor_id, vendor_name, rfc, score, strategy``; only those found.

    Equal normal names, then equal core names, then the most similar core name of the suppliers with the
    same first word; where no supplier has it, of all, by grams in place of all pairs. Names are joined once each, however often they occur.
    """
    # each name as it was written is brought to its form once; a condition on the form comes after, else it goes below the distinct and takes the form of every row
    asked = settled(names.where("name IS NOT NULL").select("name").distinct().withColumn("normal", fields.match_name(F.col("name")))).where("normal <> ''")
    forms = asked.select("normal").distinct().withColumn("core", fields.core_name(F.col("normal")))
    exact = forms.join(_first_by(vendors, "vendor_name_normalized"), F.col("normal") == F.col("k"), "left").select("normal", "core", F.col("v").alias("by_name"))
    both = exact.join(_first_by(vendors, "vendor_name_core"), F.col("core") == F.col("k"), "left").select("normal", "core", "by_name", F.col("v").alias("by_core"))
    # read by every way to find a supplier; checkpointed, as the forms cross into Python
    both = settled(both.withColumn("open", F.col("by_name").isNull() & F.col("by_core").isNull()))
    word = lambda c: F.split(F.col(c), " ")[0]
    blocks = _first_by(vendors, "vendor_name_core").select(F.col("k").alias("other"), "v", word("k").alias("word"))
    everyone = vendors.select(F.coalesce("vendor_name_core", "vendor_name_normalized").alias("other"), F.struct("id", "vendor_name", "rfc").alias("v")).where("other <> ''")
    least = F.when(F.size(F.split("core", " ")) <= 2, V.SHORT_NAME_MIN).otherwise(V.LONG_NAME_MIN)
    open_ = both.where("open").select("normal", "core", word("core").alias("word"), least.alias("least"))
    near = open_.join(_nearest(open_, blocks), "core").join(blocks.select("other", "v"), "other").select("normal", "core", "score", "v")
    rest = open_.join(blocks.select("word").distinct(), "word", "left_anti").select("normal", "core")
    # dealt by name, so that pairs are scored in many tasks; a fixed number keeps small inputs from meeting in one
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _contained(rest, everyone).repartition(parts, "normal", "core")
    far = pairs.select("normal", "core", fields.similarity(F.col("core"), F.col("other"), V.LEAST_SIMILARITY).alias("score"), "v")
    best = near.unionByName(far).groupBy("normal", "core").agg(F.max(F.struct(F.col("score"), (-F.col("v.id")).alias("o"), "v")).alias("b"))
    best = best.where((F.col("b.score") > 0) & (F.col("b.score") >= least)).select("normal", F.struct("b.v", F.bround("b.score", 4).alias("score")).alias("fuzzy"))
    found = both.join(best, "normal", "left")
    vendor = F.coalesce("by_name", "by_core", "fuzzy.v")
    result = found.select(
        "normal",
        vendor.alias("v"),
        F.when(F.col("by_name").isNotNull(), 1.0).when(F.col("by_core").isNotNull(), 0.98).otherwise(F.col("fuzzy.score")).alias("score"),
        F.when(F.col("by_name").isNotNull(), "exact_normalized_name").when(F.col("by_core").isNotNull(), "exact_core_name").otherwise("fuzzy_core_name").alias("strategy"),
    ).where("v IS NOT NULL")
    return asked.join(result, "normal").select("name", F.col("v.id").alias("vendor_id"), "v.vendor_name", "v.rfc", "score", "strategy")


def filled(documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """``documents (id, rfc, nombre_proveedor)`` with an identifier by name or a name by identifier; nothing is overwritten."""
    rows = documents.withColumns({"rfc": taxid.canonical(F.col("rfc")), "nombre_proveedor": F.nullif(F.btrim(F.coalesce("nombre_proveedor", F.lit(""))), F.lit(""))})
    by_rfc = _first_by(vendors, "rfc_normalized").select(F.col("k").alias("__k"), F.col("v.vendor_name").alias("__name"))
    rows = rows.join(by_rfc, (taxid.match_key(F.col("rfc")) == F.col("__k")) & F.col("nombre_proveedor").isNull(), "left")
    open_ = rows.where("rfc IS NULL AND nombre_proveedor IS NOT NULL").select(F.col("id").alias("key"), F.col("nombre_proveedor").alias("name"))
    by_name = matched_by_name(open_, vendors).select(F.col("key").alias("id"), F.col("rfc").alias("__rfc"))
    rows = rows.join(by_name, "id", "left")
    return rows.withColumns({"rfc": F.coalesce("rfc", "__rfc"), "nombre_proveedor": F.coalesce("nombre_proveedor", "__name")}).select(*documents.columns)


# suppliers from paths

#: Segments that say nothing and are broadcast at most.
MOST_IDLE = 1000


def path_segments(path: Column) -> Column:
    """Folders from the inside out, then the file's name without extension."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"[\\/]+"), lambda p: F.btrim(p)), lambda p: p != "")
    n = F.size(parts)
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))))
    return F.when(n > 0, F.concat(folders, F.array(without_extension(F.get(parts, n - 1))))).otherwise(F.array().cast("array<string>"))


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[A-Za-z0-9]{1,8}$", "")


def clean_segment(c: Column) -> Column:
    c = F.regexp_replace(without_extension(c), r"\(\s*\d+\s*\)", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[_\.,;:\-\[\]\{\}\|]+", " "), r"(?U)\s+", " "), F.lit(V.NAME_EDGES))


def may_be_supplier(normal: Column) -> Column:
    """Whether a segment's match name may be a supplier's: not generic, not a number, and legal or of two words."""
    core = fields.core_name(normal)
    letters = F.length(F.regexp_replace(normal, r"\P{L}", ""))
    return (
        (normal != "")
        & ~normal.isin(*V.GENERIC_SEGMENTS)
        & (core != "")
        & ~core.isin(*(s for s in V.GENERIC_SEGMENTS if s != "LINK 2026"))
        & ~normal.rlike(r"^\d{2,8}$")
        & (letters >= 4)
        & (normal.rlike(V.PATH_LEGAL_FORM) | (F.size(F.split(core, " ")) >= 2))
    )


def from_paths(paths: DataFrame, vendors: DataFrame) -> DataFrame:
    """What a path ``(key, path)`` says of its supplier: ``key, rfc, nombre_proveedor, candidate, strategy, score``; only those that say something.

    An identifier in any segment comes first, else the first segment whose name is found.
    """
    parts = paths.select("key", F.posexplode(path_segments(F.col("path"))).alias("pos", "segment")).withColumn("candidate", clean_segment(F.col("segment"))).drop("segment")
    # each different segment is read once, as folders recur in most paths
    read = parts.groupBy("candidate").agg(F.count("*").alias("n"))
    read = read.withColumns({"found": taxid.canonical(fields.tax_id(F.col("candidate"))), "normal": fields.match_name(F.col("candidate"))})
    read = settled(read.select("candidate", "n", "found", may_be_supplier(F.col("normal")).alias("named")))
    says = F.col("found").isNotNull() | F.col("named")
    # the commonest of those that say nothing need not be dealt out by their value
    idle = read.where(~says).orderBy(F.desc("n")).limit(MOST_IDLE).select("candidate")
    parts = parts.join(F.broadcast(idle), "candidate", "left_anti").join(read.where(says).select("candidate", "found", "named"), "candidate")
    first_id = F.min_by("found", F.when(F.col("found").isNotNull(), F.col("pos"))).alias("found")
    rows = settled(parts.groupBy("key").agg(first_id, F.collect_list(F.when(F.col("named"), F.struct("pos", "candidate"))).alias("names")))
    known = _first_by(vendors, "rfc_normalized")
    ids = rows.where("found IS NOT NULL").select("key", "found")
    by_id = ids.join(known, taxid.match_key(F.col("found")) == F.col("k"), "left").select(
        "key", F.col("found").alias("rfc"), F.col("v.vendor_name").alias("nombre_proveedor"), F.col("found").alias("candidate"), F.lit("path_rfc").alias("strategy"), F.lit(None).cast("double").alias("score")
    )
    names = rows.where("found IS NULL").select("key", F.inline("names")).withColumnRenamed("candidate", "name")
    hits = names.join(matched_names(names, vendors), "name")
    said = F.struct("rfc", F.coalesce("vendor_name", "name").alias("nombre_proveedor"), F.col("name").alias("candidate"), F.concat(F.lit("path_name:"), "strategy").alias("strategy"), "score")
    first = hits.groupBy("key").agg(F.min_by(said, "pos").alias("r"))
    return by_id.unionByName(first.select("key", "r.*"))
