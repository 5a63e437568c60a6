"""Input tables of the queries, and the DuckDB spelling of shared expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star schema with names that say what they refer to."""
    t = lambda name, **columns: table(spark, sf_dir, name).select(*[F.col(old).alias(new) for new, old in columns.items()])
    return {
        "Region": t("region", region_key="r_regionkey", region_name="r_name"),
        "Nation": t("nation", nation_key="n_nationkey", nation_name="n_name", region_key="n_regionkey"),
        "Customer": t("customer", customer_key="c_custkey", customer_name="c_name", nation_key="c_nationkey", segment="c_mktsegment"),
        "Supplier": t("supplier", supplier_key="s_suppkey", supplier_name="s_name", nation_key="s_nationkey"),
        "Orders": t("orders", order_key="o_orderkey", customer_key="o_custkey", order_status="o_orderstatus", priority="o_orderpriority"),
    }


RENAMED_SQL = """
    region_ AS (SELECT r_regionkey AS region_key, r_name AS region_name FROM region),
    nation_ AS (SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key FROM nation),
    customer_ AS (SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_key, c_mktsegment AS segment FROM customer),
    supplier_ AS (SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_nationkey AS nation_key FROM supplier),
    orders_ AS (SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderstatus AS order_status, o_orderpriority AS priority FROM orders)"""
RENAMED_COLUMNS = {
    "Region": ("region_key", "region_name"),
    "Nation": ("nation_key", "nation_name", "region_key"),
    "Customer": ("customer_key", "customer_name", "nation_key", "segment"),
    "Supplier": ("supplier_key", "supplier_name", "nation_key"),
    "Orders": ("order_key", "customer_key", "order_status", "priority"),
}

FLAT_COLUMNS = ("cust_key", "segment", "nation_key", "nation_name", "region_key", "region_name")
FLAT_SQL = """flat AS (SELECT c_custkey AS cust_key, c_mktsegment AS segment, n_nationkey AS nation_key, n_name AS nation_name, r_regionkey AS region_key, r_name AS region_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region in one table."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by the schema
    return joined.select(F.col("c_custkey").alias("cust_key"), F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation_name"), F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region_name"))


def sql_key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def sql_joined(x: str) -> str:
    return rf"regexp_replace(lower(trim(coalesce({x}, ''))), '[\s\-_]+', '', 'g')"


def sql_singular(t: str) -> str:
    return f"(CASE WHEN length({t}) <= 3 THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {t}[:-2] ELSE {t} END)"


def sql_tokens(x: str) -> str:
    parted = rf"lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))"
    return f"list_transform(list_filter(string_split({parted}, ' '), lambda t: t <> ''), lambda t: {sql_singular('t')})"


def sql_jaccard(a: str, b: str) -> str:
    """Of two lists."""
    shared, every = f"len(list_intersect(list_distinct({a}), list_distinct({b})))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {every} = 0 THEN 0.0 ELSE CAST({shared} AS DOUBLE) / {every} END)"


def sql_close(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END)"
