"""Queries over the supplier dimension. Names are made of three words by key, so that typos have known winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vendors as S
from ..session import settled
from .registry import register
from .standins import table

_FIRST = ("GRUPO", "ALIMENTOS", "BEBIDAS", "LACTEOS", "PANADERIA", "CARNES", "FRUTAS", "DULCES", "CEREALES", "ACEITES")
_SECOND = ("MONTERREY", "GUADALUPE", "HIDALGO", "ZARAGOZA", "MORELOS", "JUAREZ", "ALLENDE", "CORREGIDORA", "VICTORIA", "BRAVO")
_LIST = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"
#: Letters that spell a key, so that names differ in more than a digit.
_SPELT = "translate(lpad(CAST({k} AS VARCHAR), 5, '0'), '0123456789', 'QWERTYUIOP')"
_CORE_SQL = f"{_LIST(_FIRST)}[s_suppkey % 10 + 1] || ' ' || {_LIST(_SECOND)}[s_suppkey // 10 % 10 + 1] || ' ' || {_SPELT.format(k='s_suppkey')}"
_VENDORS = f"v AS (SELECT s_suppkey AS id, {_CORE_SQL} AS core, CASE WHEN s_suppkey % 4 <> 0 THEN 'ABC850101' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS rfc FROM supplier)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier list with other headers, each row twice, and empty ones among them."""
    k = F.col("s_suppkey")
    pick = lambda words, i: F.element_at(F.array(*(F.lit(w) for w in words)), (i + 1).cast("int"))
    core = F.concat_ws(" ", pick(_FIRST, k % 10), pick(_SECOND, F.floor(k / 10) % 10), F.translate(F.lpad(k.cast("string"), 5, "0"), "0123456789", "QWERTYUIOP"))
    rows = table(spark, sf_dir, "supplier").select(k, core.alias("core"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"))
    return rows.select(
        (k * 3 + F.col("copy")).alias("ordinal"),
        F.when(F.col("copy") == 2, "nan").otherwise(F.concat(F.initcap("core"), F.lit(" S.A. de C.V."))).alias("Vendor Name"),
        F.when(F.col("copy") == 2, "").when(k % 4 != 0, F.concat(F.lit("abc-850101 "), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("Tax ID"),
    )


def _vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prepared(_raw(spark, sf_dir), "ordinal")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared list as a table: several joins read it, and its forms cross into Python."""
    return settled(_vendors(spark, sf_dir))


@register("agg12_nam09_snk05_vendor_load", f"WITH {_VENDORS} SELECT id * 3 AS id, core AS vendor_name_core, core || ' SA DE CV' AS vendor_name_normalized, rfc FROM v")
def vendor_load(spark, sf_dir):
    return _vendors(spark, sf_dir).select("id", "vendor_name_core", F.regexp_replace("vendor_name_normalized", " S A ", " SA ").alias("n"), "rfc").withColumn("vendor_name_normalized", F.regexp_replace("n", "C V$", "CV")).drop("n")


@register("agg12_load_counts", "SELECT count(*) * 3 AS rows_read, count(*) AS rows_inserted, count(*) * 2 AS rows_skipped FROM supplier")
def load_counts(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return S.load_counts(raw, S.prepared(raw, "ordinal"))


_ASKED = "k AS (SELECT o_orderkey AS id, o_orderkey % 5 AS c, v.* EXCLUDE (id), v.id AS vid FROM orders JOIN v ON v.id = o_orderkey % (SELECT count(*) FROM supplier) + 1)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that name a supplier: as listed, by core name, with a typo, by identifier, and not at all."""
    vendors = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = vendors.count()
    raw = _raw(spark, sf_dir).where("ordinal % 3 = 0").select((F.col("ordinal") / 3).cast("long").alias("vid"), F.col("Vendor Name").alias("listed"), F.col("Tax ID").alias("tax"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("c"), (F.col("o_orderkey") % n + 1).alias("vid"))
    rows = o.join(raw, "vid")
    core = F.upper(F.regexp_replace("listed", r" S\.A.*$", ""))
    typo = F.concat(core.substr(F.lit(1), F.length(core) - 9), F.lit("X"), core.substr(F.length(core) - 7, F.lit(8)))
    name = F.when(F.col("c") == 0, F.col("listed")).when(F.col("c") == 1, F.concat(core, F.lit(" SA"))).when(F.col("c") == 2, typo).when(F.col("c") == 3, None).otherwise("ZZZ SIN NADA")
    return rows.select("id", "c", name.alias("nombre_proveedor"), F.when(F.col("c") == 3, F.col("tax")).alias("rfc"), "listed")


@register(
    "jn08_jn09_jn10_match_by_name",
    f"WITH {_VENDORS}, {_ASKED} SELECT id, vid * 3 AS vendor_id, CASE c WHEN 0 THEN 'exact_normalized_name' WHEN 1 THEN 'exact_core_name' ELSE 'fuzzy_core_name' END AS strategy, rfc FROM k WHERE c < 3",
)
def match_by_name(spark, sf_dir):
    asked = _asked(spark, sf_dir).where("c <> 3").select(F.col("id").alias("key"), F.col("nombre_proveedor").alias("name"))
    return S.matched_by_name(asked, _stored(spark, sf_dir)).select(F.col("key").alias("id"), "vendor_id", "strategy", "rfc")


@register(
    "jn07_nam08_fill_gaps",
    f"WITH {_VENDORS}, {_ASKED} SELECT id, CASE WHEN c < 4 THEN rfc END AS rfc, CASE WHEN c = 3 THEN rfc IS NOT NULL ELSE TRUE END AS named FROM k",
)
def fill_gaps(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("id", "rfc", "nombre_proveedor")
    return S.filled(asked, _stored(spark, sf_dir)).select("id", "rfc", F.col("nombre_proveedor").isNotNull().alias("named"))


@register(
    "jn13_txt20_txt23_path_context",
    f"WITH {_VENDORS}, {_ASKED} SELECT id, rfc, CASE WHEN id % 3 = 0 AND rfc IS NOT NULL THEN 'path_rfc' ELSE 'path_name:exact_core_name' END AS strategy FROM k WHERE id % 3 = 1 OR (id % 3 = 0 AND rfc IS NOT NULL)",
)
def path_context(spark, sf_dir):
    rows = _asked(spark, sf_dir)
    core = F.upper(F.regexp_replace("listed", r" S\.A.*$", ""))
    # the supplier's identifier comes by its name here, as only some orders carry it
    vendors = _stored(spark, sf_dir)
    ids = vendors.where("rfc IS NOT NULL").select(F.col("vendor_name").alias("listed"), F.col("rfc").alias("id_of"))
    rows = rows.join(ids, "listed", "left")
    by_id = (F.col("id") % 3 == 0) & F.col("id_of").isNotNull()
    path = F.when(by_id, F.concat(F.lit("C:\\Contratos\\RFC "), "id_of", F.lit("\\otro nombre.pdf"))).when(F.col("id") % 3 == 1, F.concat(F.lit("/data/Proveedores/"), core, F.lit(" SA/2024/0001.pdf"))).otherwise("/data/incoming/12345.pdf")
    found = S.from_paths(rows.select(F.col("id").alias("key"), path.alias("path")), vendors)
    return found.select(F.col("key").alias("id"), "rfc", "strategy")
