"""Entity-relationship models as three tables, and as nested rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTE = "name string, data_type string, is_primary_key boolean, is_foreign_key boolean, references string, nullable boolean, prov string"
ENTITY = f"name string, description string, category string, primary_key array<string>, attributes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ATTRIBUTE.split(', '))}>>, name_prov string, pk_prov string"
RELATION = "name string, from_entity string, to_entity string, from_cardinality string, to_cardinality string, fk_attribute string, pk_attribute string, relationship_type string, prov string"
#: The ends that a relationship may have.
CARDINALITIES = ("1", "0..1", "0..N", "1..N")


@dataclass(frozen=True)
class Erd:
    """entities (entity, epos, primary_key, …), attributes (entity, epos, attr, apos, data_type, is_pk, is_fk, ref_entity, ref_col, nullable, prov), relationships (rpos, from_entity, …)."""

    entities: DataFrame
    attributes: DataFrame
    relationships: DataFrame


def flat(entities: DataFrame, relationships: DataFrame) -> Erd:
    """The tables of nested rows: entities of the schema ENTITY with epos, relationships of RELATION with rpos."""
    each = entities.select(F.col("name").alias("entity"), "epos", F.posexplode("attributes").alias("apos", "a"))
    ref = F.trim("a.references")
    attributes = each.select(
        "entity", "epos", F.col("a.name").alias("attr"), "apos", F.col("a.data_type").alias("data_type"), F.coalesce("a.is_primary_key", F.lit(False)).alias("is_pk"),
        (F.coalesce("a.is_foreign_key", F.lit(False)) | (F.coalesce(ref, F.lit("")) != "")).alias("is_fk"),
        F.nullif(F.trim(F.substring_index(ref, ".", 1)), F.lit("")).alias("ref_entity"), F.when(F.contains(ref, F.lit(".")), F.nullif(F.trim(F.regexp_replace(ref, r"^[^.]*\.", "")), F.lit(""))).alias("ref_col"),
        F.col("a.nullable").alias("nullable"), F.col("a.prov").alias("prov"),
    )
    return Erd(entities.select(F.col("name").alias("entity"), "epos", F.coalesce("primary_key", F.array().cast("array<string>")).alias("primary_key"), "name_prov", "pk_prov"), attributes, relationships)


def of_rows(spark: SparkSession, erd: dict[str, Any]) -> Erd:
    """The tables of a model that is given as a document; models are small, data is not."""
    from pyspark.sql.types import StructType

    fill = lambda row, names: tuple(row.get(n) for n in names)
    kinds, attrs, rels = (StructType.fromDDL(x) for x in (ENTITY, ATTRIBUTE, RELATION))
    rows = [(*[[fill(a, attrs.names) for a in e.get("attributes") or []] if n == "attributes" else e.get(n) for n in kinds.names], i) for i, e in enumerate(erd.get("entities") or [])]
    entities = spark.createDataFrame(rows, StructType.fromDDL(ENTITY).add("epos", "integer"))
    relations = spark.createDataFrame([(*fill(r, rels.names), i) for i, r in enumerate(erd.get("relationships") or [])], StructType.fromDDL(RELATION).add("rpos", "integer"))
    return flat(entities, relations)


def nested(erd: Erd) -> DataFrame:
    """One row (entities, relationships), as a model document has them."""
    attr = F.struct("apos", F.col("attr").alias("name"), "data_type", F.col("is_pk").alias("is_primary_key"), F.col("is_fk").alias("is_foreign_key"), "prov")
    attributes = erd.attributes.groupBy("entity", "epos").agg(F.transform(F.sort_array(F.collect_list(attr)), lambda x: x.dropFields("apos")).alias("attributes"))
    rows = erd.entities.join(attributes, ["entity", "epos"], "left").select(F.struct("epos", F.col("entity").alias("name"), "primary_key", "attributes").alias("e"))
    entities = rows.agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x.dropFields("epos")).alias("entities"))
    relation = F.struct("rpos", "from_entity", "to_entity", "from_cardinality", "to_cardinality", "fk_attribute", "pk_attribute", "prov")
    relations = erd.relationships.agg(F.transform(F.sort_array(F.collect_list(relation)), lambda x: x.dropFields("rpos")).alias("relationships"))
    return entities.crossJoin(relations)
