"""Matching the concepts of two ontologies: lexical, structural and instance similarity, then one-to-one alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.names import joined_key
from schemaloom.functions.similarity import lexical, overlap, structural
from schemaloom.operators.assign import greedy
from schemaloom.operators.common import cells

#: Weights of the three similarities and the least score of an alignment.
LEXICAL, STRUCTURAL, INSTANCE, LEAST = 0.30, 0.50, 0.20, 0.35


def fingerprints(concepts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(concept, pos, category, source, properties, targets) of concepts (concept, pos, category, source) and attributes (concept, mapping_type, canonical, target)."""
    sets = attributes.groupBy("concept").agg(
        F.collect_set(F.when(~F.col("mapping_type").eqNullSafe("relation_role"), F.nullif(joined_key("canonical"), F.lit("")))).alias("properties"),
        F.collect_set(F.when(F.col("mapping_type") == "relation_role", F.nullif(joined_key("target"), F.lit("")))).alias("targets"),
    )
    empty = F.array().cast("array<string>")
    return concepts.join(sets, "concept", "left").select("concept", "pos", joined_key("category").alias("category"), "source", F.coalesce("properties", empty).alias("properties"), F.coalesce("targets", empty).alias("targets"))


def instance_values(entities: dict[str, DataFrame]) -> DataFrame:
    """(source, value): the distinct trimmed lower-case values of each entity, all its columns together."""
    out = None
    for name, df in entities.items():
        part = cells(df).select(F.lit(name).alias("source"), F.lower(F.trim("value")).alias("value")).filter("value <> ''").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def value_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_source, b_source, instance): shared values as a share of all, for pairs that share any; found by value, not pair by pair."""
    size = lambda df, n: F.broadcast(df.groupBy("source").agg(F.count(F.lit(1)).alias(f"n_{n}")).withColumnRenamed("source", f"{n}_source"))  # noqa: E731  a row for each entity
    shared = a.select(F.col("source").alias("a_source"), "value").join(b.select(F.col("source").alias("b_source"), "value"), "value").groupBy("a_source", "b_source").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(size(a, "a"), "a_source").join(size(b, "b"), "b_source")
    return both.select("a_source", "b_source", overlap(F.col("shared"), F.col("n_a"), F.col("n_b")).alias("instance"))


def pair_scores(a: DataFrame, b: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """(i, j, a, b, a_source, b_source, score) of every pair of concepts of two ontologies; concepts are metadata, so all pairs are scored."""
    side = lambda df, n: df.select(*[F.col(c).alias(f"{n}_{c}") for c in df.columns])
    pairs = side(a, "a").crossJoin(F.broadcast(side(b, "b")))
    if overlaps is None:
        pairs = pairs.withColumn("instance", F.lit(0.0))
    else:
        low = overlaps.groupBy(F.lower("a_source").alias("_x"), F.lower("b_source").alias("_y")).agg(F.max("instance").alias("instance"))
        pairs = pairs.join(F.broadcast(low), (F.lower("a_source") == F.col("_x")) & (F.lower("b_source") == F.col("_y")), "left")
    c = F.col
    score = LEXICAL * lexical(c("a_concept"), c("b_concept")) + STRUCTURAL * structural(c("a_category"), c("b_category"), c("a_targets"), c("b_targets"), c("a_properties"), c("b_properties")) + INSTANCE * F.coalesce("instance", F.lit(0.0))
    return pairs.select(c("a_pos").alias("i"), c("b_pos").alias("j"), c("a_concept").alias("a"), c("b_concept").alias("b"), "a_source", "b_source", score.alias("score"))


def align(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """The best pairs one to one; ties go to later concepts."""
    return greedy(scores.filter(F.col("score") >= least), "i", "j", ["score", "i", "j"]).select("i", "j", "a", "b", "a_source", "b_source", "score")


def integrate(a: DataFrame, b: DataFrame, overlaps: DataFrame | None = None) -> dict[str, DataFrame]:
    """The integration plan of two fingerprint tables: alignments (canonical, a, b, score; a and b are the source entities), unique_to_a, unique_to_b and integrated concepts (name)."""
    found = align(pair_scores(a, b, overlaps))
    only = lambda df, n: df.join(found.select(F.col(n).alias("pos")), "pos", "left_anti").select(F.col("concept").alias("name"))
    unique_a, unique_b = only(a, "i"), only(b, "j")
    alignments = found.select(F.col("a").alias("canonical"), F.col("a_source").alias("a"), F.col("b_source").alias("b"), "score")
    return {"alignments": alignments, "unique_to_a": unique_a, "unique_to_b": unique_b, "integrated": alignments.select(F.col("canonical").alias("name")).union(unique_a).union(unique_b)}
