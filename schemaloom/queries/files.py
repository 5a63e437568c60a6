"""Queries through files and on their results: scans, written results, metric tables, models as files give them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import validate
from schemaloom.operators.common import shared_root
from schemaloom.operators.model import of_rows
from schemaloom.queries.common import RENAMED_COLUMNS, renamed, table
from schemaloom.sources import files


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/queries/{uuid.uuid4().hex}"


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through CSV files with a repeated column name, words for nothing, quotes, commas and line breaks in cells."""
    path = _folder(spark)
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\nthen '), "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), note.alias("note"), F.lit(" ").alias("blank"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.csv(spark, path, names=["key", "status", "note", "status"])


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three runs, appended one after another: of each key the last one counts."""
    path, n = _folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    files.append_results(n.select("n_nationkey", F.lit("first").alias("run")), path, "a")
    files.append_results(n.filter("n_regionkey > 1").select("n_nationkey", F.lit("second").alias("run")), path, "b")
    files.append_results(n.filter("n_regionkey > 3").select("n_nationkey", F.lit("third").alias("run")), path, "c")
    return files.latest_results(spark, path, ["n_nationkey"]).select("n_nationkey", "run")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and least keys of each status and priority, a column for each measure."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("scenario"))
    rows, least = (o.agg(x.cast("double").alias("mean")).select("target", "scenario", F.lit(n).alias("metric"), "mean") for n, x in (("n_orders", F.count(F.lit(1))), ("least_key", F.min("o_orderkey"))))
    return files.metric_table(rows.union(least))


def fitting_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that fits each entity best among five, and whether its rows keep the entity's normal form."""
    parts = renamed(spark, sf_dir)
    entities = [{"name": f"My{e}", "primary_key": [cs[0]], "attributes": [{"name": c.upper()} for c in cs]} for e, cs in RENAMED_COLUMNS.items() if e in ("Region", "Supplier")]
    entities.append({"name": "Other", "primary_key": ["x"], "attributes": [{"name": "x"}]})
    return validate.normal_form_checks(parts, of_rows(spark, {"entities": entities})).select("entity", "tbl")


QUERIES = {f.__name__: f for f in (csv_scan, latest_results, metric_table, fitting_tables)}
ORACLE = {
    "csv_scan": """SELECT CAST(o_orderkey AS VARCHAR) AS "key", nullif(o_orderstatus, 'F') AS status, 'said "' || o_orderpriority || '",' || chr(10) || 'then ' || o_orderstatus AS note, CAST(NULL AS VARCHAR) AS "status.1" FROM orders""",
    "latest_results": "SELECT n_nationkey, CASE WHEN n_regionkey > 3 THEN 'third' WHEN n_regionkey > 1 THEN 'second' ELSE 'first' END AS run FROM nation",
    "metric_table": "SELECT o_orderstatus AS target, o_orderpriority AS scenario, CAST(count(*) AS DOUBLE) AS n_orders, CAST(min(o_orderkey) AS DOUBLE) AS least_key FROM orders GROUP BY 1, 2",
    "fitting_tables": "SELECT * FROM (VALUES ('MyRegion', 'Region'), ('MySupplier', 'Supplier'), ('Other', NULL)) t(entity, tbl)",
}
