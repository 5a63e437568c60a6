"""Tables and models from files, results to files. Paths may be on any store that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from schemaloom.operators.model import ENTITY, RELATION, Erd, flat

#: Cells that mean nothing is there, beside the empty cell.
NOTHING = ("NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A")

MAPS_TO = "struct<type: string, canonical_name: string, role: string, relation: string, target_concept: string, accepted: array<string>>"
CONCEPTS = f"array<struct<canonical_name: string, ontological_category: string, source_entity: string, attributes: array<struct<source: string, maps_to: {MAPS_TO}>>>>"
RELATIONS = "array<struct<canonical_name: string, domain: string, range: string, accepted: array<string>>>"


def unique_names(names: Sequence[Any]) -> list[str]:
    """Column names as text; repeated ones get .1, .2, …"""
    out: list[str] = []
    for name in map(str, names):
        k, found = 0, name
        while found in out:
            k += 1
            found = f"{name}.{k}"
        out.append(found)
    return out


def csv(spark: SparkSession, path: str, nulls: bool = True, names: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with header as text columns; empty and nothing-words are null, or stay as they are without ``nulls``.

    Repeated header names get a number. Types are inferred by ``profile.types``, not by the reader.
    """
    if names is None:
        head = spark.read.option("header", False).option("multiLine", True).csv(path).limit(1).first()
        names = [x if x is not None else f"Unnamed: {i}" for i, x in enumerate(head or ())]
    schema = StructType([StructField(n, StringType()) for n in unique_names(names)])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)
    if nulls:
        return df.select(*[F.when(~F.trim(f"`{c}`").isin("", *NOTHING), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in df.columns])


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): a file as one text, for prompts."""
    return spark.read.text(path, wholetext=True)


def tables(frames: Sequence[DataFrame], names: Sequence[str] | None = None) -> list[tuple[str, DataFrame]]:
    """Tables with names; those without one are Table1, Table2, …"""
    given = list(names or [])
    return [(given[i] if i < len(given) else f"Table{i + 1}", df.toDF(*unique_names(df.columns))) for i, df in enumerate(frames)]


def erd(spark: SparkSession, path: str) -> Erd:
    """A model document (entities, relationships)."""
    entity, relation = (StructType.fromDDL(x) for x in (ENTITY, RELATION))
    doc = StructType.fromDDL(f"entities array<{entity.simpleString()}>, relationships array<{relation.simpleString()}>")
    raw = spark.read.schema(doc).option("multiLine", True).json(path)
    entities = raw.select(F.posexplode("entities").alias("epos", "e")).select("e.*", "epos")
    relations = raw.select(F.posexplode_outer("relationships").alias("rpos", "r")).filter("rpos is not null").select("r.*", "rpos")
    return flat(entities, relations)


def ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An ontology document as concepts, attributes (with accepted names) and relations."""
    raw = spark.read.schema(f"concepts {CONCEPTS}, relations {RELATIONS}").option("multiLine", True).json(path)
    return ontology_tables(raw)


def ontology_tables(raw: DataFrame) -> dict[str, DataFrame]:
    each = raw.select(F.posexplode("concepts").alias("pos", "c"))
    concepts = each.select(F.col("c.canonical_name").alias("concept"), "pos", F.coalesce("c.ontological_category", F.lit("kind")).alias("category"), F.col("c.source_entity").alias("source"))
    attrs = each.select(F.col("c.canonical_name").alias("concept"), F.posexplode("c.attributes").alias("pos", "a"))
    m = "a.maps_to."
    name = F.when(F.col(m + "type") == "relation_role", F.col(m + "relation")).otherwise(F.col(m + "canonical_name"))
    accepted = F.coalesce(m + "accepted", F.array().cast("array<string>"))
    attributes = attrs.select("concept", "pos", F.col("a.source").alias("source"), F.col(m + "type").alias("mapping_type"), name.alias("canonical"), F.col(m + "role").alias("role"), F.col(m + "target_concept").alias("target"), accepted.alias("accepted"))
    relations = raw.select(F.explode_outer("relations").alias("r")).filter("r is not null").select(F.col("r.canonical_name").alias("canonical"), "r.domain", "r.range", "r.accepted")
    return {"concepts": concepts, "attributes": attributes, "relations": relations}


def brief(spark: SparkSession, path: str) -> DataFrame:
    """(text): a JSON array of sentences as a list with dashes."""
    lines = F.from_json("value", "array<string>")
    return whole_text(spark, path).select(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n").alias("text"))


def proposal(answers: DataFrame, schema: str, column: str = "answer") -> DataFrame:
    """answers with the column doc: the JSON of an answer, or of its outermost braces if words stand around them; null if neither can be read."""
    text = F.when(F.try_parse_json(column).isNull(), F.regexp_extract(column, r"(?s)\{.*\}", 0)).otherwise(F.col(column))
    return answers.withColumn("doc", F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)))


class RunExists(RuntimeError):
    """Another writer has committed results under this run's id."""


def append_results(results: DataFrame, path: str, run_id: str) -> None:
    """Add the results of a run; nothing that is there is rewritten.

    The rows go to a folder of their own; then a pointer to it is renamed to the run's name, which must not exist yet. A
    failed or killed run leaves rows that no pointer names and nobody reads; of two writers of one run the second fails.
    """
    spark, path = results.sparkSession, path.rstrip("/")
    folder = f"{path}/rows/{uuid.uuid4().hex}"
    results.withColumn("run_id", F.lit(run_id)).withColumn("written_at", F.current_timestamp()).write.parquet(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    draft, final = hadoop.Path(f"{folder}.run"), hadoop.Path(f"{path}/runs/{quote(run_id, safe='')}")
    store = final.getFileSystem(conf)
    out = store.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    store.mkdirs(final.getParent())
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(store.getUri(), conf).rename(draft, final, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise RunExists(run_id) from None
        raise


def all_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs, with run_id and written_at."""
    folders = [r[0] for r in spark.read.text(f"{path.rstrip('/')}/runs/*", wholetext=True).collect()]  # one for each run
    return spark.read.option("mergeSchema", True).parquet(*folders)


def latest_results(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Of each key the row that was written last."""
    df = all_results(spark, path)
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct("written_at", "run_id"))
    return df.groupBy(*[F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)]).agg(last.alias("row")).select("row.*")


def write_json(results: DataFrame, path: str, run_id: str) -> None:
    """Results as JSON lines below a folder of the run."""
    results.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/run_id={run_id}")


def write_report(summary: DataFrame, audit: DataFrame, path: str) -> None:
    """One JSON document for each target and scenario: means, deviations and the itemised audit."""
    stats = summary.groupBy("target", "scenario").agg(F.max("runs").alias("n_runs"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "mean")))).alias("metrics_mean"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "std")))).alias("metrics_std"))
    items = audit.groupBy("target", "scenario").agg(F.sort_array(F.collect_list(F.struct(*[c for c in audit.columns if c not in ("target", "scenario")]))).alias("matching_audit"))
    stats.join(items, ["target", "scenario"], "left").write.mode("overwrite").partitionBy("target", "scenario").json(path)


def metric_table(summary: DataFrame) -> DataFrame:
    """A row for each target and scenario, a column for each metric."""
    return summary.groupBy("target", "scenario").pivot("metric").agg(F.first("mean"))
