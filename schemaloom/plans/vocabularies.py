"""The vocabulary of a model as one run: proposals or rules, then merging, hygiene, coverage, hints and meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.names import bare_key, entity_label
from schemaloom.operators import integrate, ontology, sampling
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.common import checkpointed
from schemaloom.operators.inds import table_index
from schemaloom.operators.model import Erd
from schemaloom.operators.profile import value_kind

TERMS = "name string, description string, synonyms array<string>, sources array<string>, pos int"
MAPPINGS = "attribute string, canonical string, confidence double, rationale string, seq long"
ENTITIES = "source_entity string, canonical string, confidence double, rationale string, seq long"
METHODS = ("proposal", "plain", "algorithmic", "rule_based")


@dataclass(frozen=True)
class Vocabulary:
    """terms (with archived ones apart), mappings, entities; semantics has a row for each attribute once a run has judged its values."""

    terms: DataFrame
    mappings: DataFrame
    entities: DataFrame
    archived: DataFrame | None = None
    semantics: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Vocabulary:
        return cls(*[spark.createDataFrame([], kind) for kind in (TERMS, MAPPINGS, ENTITIES)])


def settled(df: DataFrame) -> DataFrame:
    """A table of metadata (some rows for each column of a model) as literal rows, so that each step starts from a short plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns and types, missing ones null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def evidence_of(data: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(evidence, kinds) for ``voc.build_terms``: value overlaps of all columns of the data by bare name, and what their values are, from one index of all values (long texts by digest)."""
    if not data:
        raise ValueError("no data")
    index = by_name(table_index(data))
    values = checkpointed(index.select(F.col("col").alias("source"), F.lower(F.trim("value")).alias("value")).filter("value <> ''").distinct())
    overlaps = integrate.value_overlaps(values, values).select(F.col("a_source").alias("a"), F.col("b_source").alias("b"), F.col("instance").alias("overlap"))
    return checkpointed(overlaps), checkpointed(value_kind(index).select(F.col("col").alias("part"), "kind"))


def by_name(index: DataFrame) -> DataFrame:
    """An index of tables' values as one by the columns' bare names (col, pos, value, cnt), written."""
    return checkpointed(index.groupBy(bare_key("col").alias("col"), F.lit(0).alias("pos"), "value").agg(F.sum("cnt").alias("cnt")))


def _canonical_entities(existing: Vocabulary) -> DataFrame:
    """(canonical, attrs): the canonical entities and the bare names of all attributes mapped from their source entities."""
    sources = existing.entities.filter("canonical <> ''").select("canonical", F.lower("canonical").alias("low"), F.lower("source_entity").alias("source"))
    mapped = existing.mappings.filter(F.contains("attribute", F.lit("."))).select(F.lower(F.trim(F.substring_index("attribute", ".", 1))).alias("source"), bare_key(F.regexp_replace("attribute", r"^[^.]*\.", "")).alias("attr"))
    attrs = sources.select("low", "source").distinct().join(mapped, "source").groupBy("low").agg(F.collect_set("attr").alias("attrs"))
    return sources.select("canonical", "low").distinct().join(attrs, "low", "left").select("canonical", F.coalesce("attrs", F.array().cast("array<string>")).alias("attrs"))


def algorithmic(erd: Erd, existing: Vocabulary | None = None, data: dict[str, DataFrame] | None = None) -> Vocabulary:
    """Entities and attributes matched with an existing vocabulary by name, values and structure; what matches nothing is new."""
    spark = erd.entities.sparkSession
    existing = existing or Vocabulary.empty(spark)
    evidence, kinds = evidence_of(data) if data else (spark.createDataFrame([], "a string, b string, overlap double"), spark.createDataFrame([], "part string, kind string"))
    attrs = erd.attributes.groupBy("entity").agg(F.collect_set(bare_key("attr")).alias("attrs"))
    entities = erd.entities.select("entity", "epos").join(attrs, "entity", "left").withColumn("attrs", F.coalesce("attrs", F.array().cast("array<string>")))
    linked = erd.relationships.select(F.col("from_entity").alias("entity")).union(erd.relationships.select("to_entity"))
    found = voc.build_entities(entities, _canonical_entities(existing), linked)
    mappings, terms = voc.build_terms(erd.attributes, existing.terms, evidence, kinds)
    reason = F.when(F.col("is_new"), "new").otherwise("matched").alias("rationale")
    return Vocabulary(_shaped(terms, TERMS), _shaped(mappings.select("*", reason), MAPPINGS), _shaped(found.select("*", reason, F.col("epos").alias("seq")), ENTITIES))


def of_ontology(found: dict[str, DataFrame], qualified: bool = True) -> Vocabulary:
    """The vocabulary of an ontology (concepts, attributes), as it is."""
    out = ontology.vocabulary_of(found["concepts"], found["attributes"], qualified)
    numbered = lambda df, key, name: df.join(df.select(key).distinct().select(key, (F.row_number().over(voc.Window.orderBy(key)) - 1).alias(name)), key)  # noqa: E731  metadata
    mappings = numbered(out["mappings"].withColumnRenamed("seq", "place"), "place", "seq")
    return Vocabulary(_shaped(numbered(out["terms"], "name", "pos"), TERMS), _shaped(mappings, MAPPINGS), _shaped(out["entities"], ENTITIES))


def rule_based(erd: Erd) -> Vocabulary:
    """The vocabulary of the rules' ontology, as it is."""
    return of_ontology(ontology.rule_based(erd))


def plain(erd: Erd, existing: Vocabulary | None = None) -> Vocabulary:
    """A term for each attribute name, beside what the existing vocabulary has; terms of the same name are one."""
    spark = erd.entities.sparkSession
    existing = existing or Vocabulary.empty(spark)
    own = voc.plain_vocabulary(erd.attributes)
    last = existing.terms.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("last"))
    both = existing.terms.withColumn("side", F.lit(0)).unionByName(_shaped(own.crossJoin(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("last")), TERMS).withColumn("side", F.lit(1)))
    rows = F.sort_array(F.collect_list(F.struct("side", "pos", "description", "synonyms", "sources")))
    grouped = both.groupBy("name").agg(rows.alias("rows"))
    terms = grouped.select("name", F.get("rows", 0)["description"].alias("description"), F.flatten(F.transform("rows", lambda r: r["synonyms"])).alias("synonyms"), F.flatten(F.transform("rows", lambda r: r["sources"])).alias("sources"), F.get("rows", 0)["pos"].alias("pos"))
    named = own.select("name", F.explode("sources").alias("attribute"))
    place = erd.attributes.select(F.concat_ws(".", "entity", "attr").alias("attribute"), (F.col("epos") * 100_000 + F.col("apos")).alias("seq"))
    mappings = named.join(place, "attribute").select("attribute", F.col("name").alias("canonical"), F.lit(0.5).alias("confidence"), F.lit("plain").alias("rationale"), "seq")
    known = existing.entities.select(bare_key("source_entity").alias("key")).distinct()
    fresh = erd.entities.withColumn("key", bare_key("entity")).filter("key <> ''").join(known, "key", "left_anti").groupBy("key").agg(F.min_by("entity", "epos").alias("source_entity"), F.min("epos").alias("seq"))
    entities = fresh.select("source_entity", entity_label("source_entity").alias("canonical"), F.lit(0.5).alias("confidence"), F.lit("plain").alias("rationale"), "seq")
    return Vocabulary(_shaped(terms, TERMS), voc.carried_forward(existing.mappings, _shaped(mappings, MAPPINGS)), voc.carried_forward(existing.entities, _shaped(entities, ENTITIES)))


def _spelled_as_model(mappings: DataFrame, erd: Erd) -> DataFrame:
    """Mappings whose attribute is one of the model's, letter by letter."""
    known = erd.attributes.select(F.concat_ws(".", "entity", "attr").alias("attribute")).distinct()
    return mappings.join(F.broadcast(known), "attribute", "left_semi").select(*mappings.columns)


def _sources_as_model(terms: DataFrame, erd: Erd) -> DataFrame:
    known = erd.attributes.select(F.concat_ws(".", "entity", "attr").alias("source")).distinct()
    each = terms.select("pos", F.posexplode("sources").alias("place", "source")).join(F.broadcast(known), "source", "left_semi")
    kept = each.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("kept"))
    return terms.join(kept, "pos", "left").withColumn("sources", F.coalesce("kept", F.array().cast("array<string>"))).select(*terms.columns)


def semantics_of(erd: Erd, hints: DataFrame, data: dict[str, DataFrame] | None) -> DataFrame:
    """(entity, attr, logical_type, normalization, semantic_role, domain, unit, currency, confidence) of each attribute, from its name, type and whole column of values."""
    spark = erd.entities.sparkSession
    samples, index = spark.createDataFrame([], "part string, samples array<string>"), spark.createDataFrame([], "col string, pos int, value string, cnt long")
    for df in (data or {}).values():
        first = sampling.first_values(df, df.columns)
        samples = samples.unionByName(first.groupBy(bare_key("col").alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples")))
    if data:
        index = by_name(table_index(data))
    samples = settled(samples.groupBy("part").agg(F.first("samples").alias("samples")))  # some values for each column
    return voc.enriched(erd.attributes, samples, index, hints)


def build_vocabulary(erd: Erd, method: str = "plain", proposal: Vocabulary | None = None, existing: Vocabulary | None = None, data: dict[str, DataFrame] | None = None, hints: bool = True) -> Vocabulary:
    """The vocabulary of a model.

    ``proposal`` (a naming provider's answer) is merged with the existing vocabulary; ``plain`` needs neither. Both then go
    through repair of entity names, abstraction of terms, the approved mappings, one mapping for each attribute, coverage,
    hints, ownership of sources, meaning of the columns, and coverage of entities; terms that nothing uses are archived.
    ``algorithmic`` and ``rule_based`` are taken as they come. ``data`` maps a table's name to its rows.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if method == "algorithmic":
        return algorithmic(erd, existing, data)
    if method == "rule_based":
        return rule_based(erd)
    if method == "proposal":
        if proposal is None:
            raise ValueError("a proposal is needed")
        terms, mappings, entities = proposal.terms, proposal.mappings, proposal.entities
        if existing is not None:
            joined = voc.joined_names(existing.terms, terms)
            merged = settled(voc.merge_terms(existing.terms, terms))
            names = joined.join(merged.select("name", F.lower("name").alias("low")), F.lower("target") == F.col("low")).select("key", "name")
            mappings = mappings.withColumn("key", F.lower("canonical")).join(F.broadcast(names), "key", "left").withColumn("canonical", F.coalesce("name", "canonical")).select(*mappings.columns)
            terms = merged
    else:
        start = plain(erd, existing)
        terms, mappings, entities = start.terms, start.mappings, start.entities
    erd = Erd(settled(erd.entities), settled(erd.attributes), settled(erd.relationships))
    attributes = erd.attributes
    mappings = _spelled_as_model(voc.repaired_prefixes(_shaped(mappings, MAPPINGS), attributes), erd)
    terms = _sources_as_model(voc.repaired_sources(_shaped(terms, TERMS), attributes), erd)
    terms, mappings = voc.abstract_terms(settled(terms), settled(mappings))
    if existing is not None:
        mappings = voc.carried_forward(existing.mappings, mappings)
    mappings = settled(voc.valid_mappings(voc.deduplicated(mappings), attributes))
    terms, mappings = (settled(x) for x in voc.aligned(settled(terms), mappings))
    filled = voc.covered(mappings, attributes, terms)
    last = mappings.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("last"))
    more = filled.crossJoin(F.broadcast(last)).withColumn("seq", F.row_number().over(voc.Window.orderBy("epos", "apos")) - 1 + F.col("last"))
    mappings = settled(mappings.unionByName(_shaped(more.withColumn("rationale", F.concat(F.lit("coverage: "), "source")), MAPPINGS)))
    terms, mappings = (settled(x) for x in voc.aligned(terms, mappings))
    unpacked = {k: settled(df) for k, df in ontology.unpacking(erd).items()}
    if hints:
        mappings, terms = voc.reify(mappings, unpacked["attributes"], terms)
    mappings = settled(voc.valid_mappings(voc.deduplicated(_shaped(mappings, MAPPINGS)), attributes))
    terms, mappings = (settled(x) for x in voc.aligned(_shaped(terms, TERMS), mappings))
    terms = voc.owned_sources(terms, mappings)
    kept, archived = voc.archive(settled(terms), mappings)
    if hints:
        kept = voc.annotated(kept, unpacked["attributes"], unpacked["reifications"])
    semantics = semantics_of(erd, unpacked["attributes"] if hints else unpacked["attributes"].limit(0), data)
    finished = voc.finalized_entities(_shaped(entities, ENTITIES), erd.entities, existing.entities if existing is not None else None)
    return Vocabulary(kept, mappings, finished, archived, semantics)
