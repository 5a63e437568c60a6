"""From entity-relationship models to ontologies of concepts, properties and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.names import attribute_role, camel, entity_label, last_part, pascal, preferred_term, spaceless_key, tokens
from schemaloom.operators.model import Erd


def rule_based(erd: Erd) -> dict[str, DataFrame]:
    """concepts (concept, pos, category, source), attributes (concept, source, mapping_type, canonical, role, target) and relations (canonical, domain, range).

    An entity whose primary key holds foreign keys to two entities or more is a link: a relation if it has no attribute
    of its own, else a relator; others are kinds. Columns that are no foreign keys are properties. Foreign keys that
    together cover the target's whole key are one relation, else each is one, named by its column if there are several.
    """
    attrs = erd.attributes
    keyed = erd.entities.select("entity", F.explode("primary_key").alias("attr"))
    targets = keyed.join(attrs.filter("is_fk and ref_entity is not null"), ["entity", "attr"]).groupBy("entity").agg(F.count_distinct("ref_entity").alias("linked"))
    own = attrs.groupBy("entity").agg(F.count_if(~F.col("is_pk") & ~F.col("is_fk")).alias("own"))
    kinds = erd.entities.join(targets, "entity", "left").join(own, "entity", "left")
    link = F.coalesce("linked", F.lit(0)) >= 2
    kinds = kinds.select("entity", "epos", (link & (F.coalesce("own", F.lit(0)) == 0)).alias("junction"), F.when(link & (F.col("own") >= 1), "relator").otherwise("kind").alias("category"))
    keys = erd.entities.select(F.col("entity").alias("ref_entity"), F.array_sort(F.array_distinct("primary_key")).alias("target_key"))
    member = F.struct("apos", "attr", "ref_col")
    groups = attrs.filter("is_fk and ref_entity is not null").groupBy("entity", "ref_entity").agg(F.sort_array(F.collect_list(member)).alias("members"), F.min("apos").alias("first"))
    cols = F.array_sort(F.array_distinct(F.array_compact(F.transform("members", lambda m: m["ref_col"]))))
    whole = (F.size("members") >= 2) & (F.size(cols) == F.size("members")) & (cols == F.col("target_key"))
    groups = groups.join(keys, "ref_entity", "left").withColumn("whole", F.coalesce(whole, F.lit(False)))
    has = F.concat(F.lit("has"), pascal("ref_entity"))
    sources = F.transform("members", lambda m: F.concat_ws(".", "entity", m["attr"]))
    one = groups.filter("whole").select("entity", "first", F.lit(0).alias("apos"), F.array_join(sources, ", ").alias("source"), has.alias("canonical"), F.col("ref_entity").alias("target"))
    several = F.size("members") > 1
    each = groups.filter("not whole").select("entity", "ref_entity", "first", several.alias("several"), F.explode("members").alias("m"))
    each = each.select("entity", "first", "m.apos", F.concat_ws(".", "entity", "m.attr").alias("source"), F.when(F.col("several"), camel("m.attr")).otherwise(has).alias("canonical"), F.col("ref_entity").alias("target"))
    roles = one.unionByName(each).select("entity", F.struct(F.lit(1).alias("x"), F.col("first").alias("y"), F.col("apos").alias("z")).alias("order"), "source", F.lit("relation_role").alias("mapping_type"), "canonical", F.lit(None).cast("string").alias("role"), "target")
    props = attrs.filter("not is_fk").select("entity", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("apos").alias("z")).alias("order"), F.concat_ws(".", "entity", "attr").alias("source"), F.lit("property").alias("mapping_type"), camel("attr").alias("canonical"), F.when(F.col("is_pk"), "identifier").otherwise("descriptive").alias("role"), F.lit(None).cast("string").alias("target"))
    concepts = kinds.filter("not junction").select(pascal("entity").alias("concept"), F.col("epos").alias("pos"), "category", F.col("entity").alias("source"))
    attributes = concepts.select("concept", F.col("source").alias("entity")).join(props.unionByName(roles), "entity")
    place = F.row_number().over(Window.partitionBy("entity").orderBy("order"))
    ends = kinds.filter("junction").join(groups, "entity").groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "ref_entity"))), lambda x: x["ref_entity"]).alias("t"))
    ends = ends.filter(F.size("t") >= 2).select(F.get("t", F.lit(0)).alias("domain"), F.get("t", F.lit(1)).alias("range"))
    relations = ends.select(F.concat(F.lit("links"), pascal("domain"), pascal("range")).alias("canonical"), "domain", "range")
    return {"concepts": concepts, "attributes": attributes.withColumn("pos", place).select("concept", "pos", "source", "mapping_type", "canonical", "role", "target"), "relations": relations}


def unpacking(erd: Erd) -> dict[str, DataFrame]:
    """entities (entity, kind, fk_count, own_count), attributes (entity, attr, role, preferred) and reifications (entity, label): hints for naming."""
    counted = erd.attributes.groupBy("entity").agg(F.count_if("is_fk").alias("fk_count"), F.count_if(~F.col("is_fk") & ~F.col("is_pk")).alias("own_count"))
    kind = F.when((F.col("fk_count") >= 2) & (F.col("own_count") > 0), "relator").when(F.col("fk_count") >= 2, "association").otherwise("entity")
    entities = erd.entities.select("entity", "epos").join(counted, "entity", "left").select("entity", "epos", kind.alias("kind"), F.coalesce("fk_count", F.lit(0)).alias("fk_count"), F.coalesce("own_count", F.lit(0)).alias("own_count"))
    rows = erd.attributes.join(F.broadcast(entities.select("entity", "kind")), "entity").withColumns({"words": tokens("attr"), "entity_words": tokens("entity")})
    rows = rows.withColumn("role", attribute_role(F.col("words"), F.col("is_pk"), F.col("is_fk"), F.col("kind")))
    attributes = rows.select("entity", "epos", "attr", "apos", "role", preferred_term(F.col("words"), F.col("entity_words"), F.col("role")).alias("preferred"))
    return {"entities": entities, "attributes": attributes, "reifications": entities.filter("kind = 'relator'").select("entity", entity_label("entity").alias("label"))}


def with_scaffold(proposal: DataFrame, scaffold: DataFrame) -> DataFrame:
    """The scaffold's rows (source, canonical, …) with the proposal's names; of several names for a source the first wins. Both: (source, canonical, pos)."""
    key = lambda c: F.array_join(F.array_sort(F.transform(F.split(c, ","), spaceless_key)), ",")
    named = proposal.filter("canonical is not null and canonical <> ''").groupBy(key(F.col("source")).alias("key")).agg(F.min_by("canonical", "pos").alias("name"))
    return scaffold.withColumn("key", key(F.col("source"))).join(named, "key", "left").withColumn("canonical", F.coalesce("name", "canonical")).drop("key", "name")


def vocabulary_of(concepts: DataFrame, attributes: DataFrame, qualified: bool = True) -> dict[str, DataFrame]:
    """An ontology's entities, mappings and terms as ``scores.mapping_scores`` takes them; a combined source gives one mapping for each column."""
    entities = concepts.select(F.col("source").alias("source_entity"), F.col("concept").alias("canonical"), "category", F.col("pos").alias("seq"))
    owner = concepts.select("concept", F.col("pos").alias("_c"), F.col("source").alias("_owner"))
    each = attributes.join(F.broadcast(owner), "concept").select("*", F.posexplode(F.transform(F.split("source", ","), F.trim)).alias("_i", "_part")).filter("_part <> ''")
    full = F.when(F.contains("_part", F.lit(".")), F.concat_ws(".", F.trim(F.substring_index("_part", ".", 1)), F.trim(last_part("_part")))).otherwise(F.concat_ws(".", "_owner", "_part"))
    accepted = F.col("accepted") if "accepted" in attributes.columns else F.array().cast("array<string>")
    place = F.struct(F.col("_c").alias("c"), F.col("pos").alias("a"), F.col("_i").alias("i"))
    mappings = each.select((full if qualified else F.trim(last_part("_part"))).alias("attribute"), "canonical", F.coalesce("mapping_type", F.lit("property")).alias("mapping_type"), accepted.alias("accepted"), place.alias("seq"), "concept")
    sources = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "attribute"))), lambda x: x["attribute"]))
    terms = mappings.groupBy(F.col("canonical").alias("name")).agg(F.concat(F.lit("Concept: "), F.min_by("concept", "seq")).alias("description"), F.array().cast("array<string>").alias("synonyms"), sources.alias("sources"))
    return {"entities": entities, "mappings": mappings.drop("concept"), "terms": terms}


def concepts_of(entities: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """Concepts and attributes of a flat vocabulary; everything is a kind or a property."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_entity")) - 1
    concepts = entities.select(F.col("canonical").alias("concept"), place.alias("pos"), F.lit("kind").alias("category"), F.col("source_entity").alias("source"))
    owner = F.trim(F.substring_index("attribute", ".", 1))
    attributes = mappings.withColumn("source_entity", owner).join(entities.select("source_entity", F.col("canonical").alias("concept")), "source_entity")
    return {"concepts": concepts, "attributes": attributes.select("concept", F.col("attribute").alias("source"), F.lit("property").alias("mapping_type"), "canonical", F.lit(None).cast("string").alias("target"))}


def erd_text(erd: Erd) -> DataFrame:
    """(text): a line for each entity with its attributes, then one for each relationship."""
    mark = F.concat("attr", F.lit(" "), F.coalesce("data_type", F.lit("")), F.when(F.col("is_pk"), " PK").otherwise(""), F.when(F.col("is_fk"), F.concat(F.lit(" FK"), F.coalesce(F.concat(F.lit(" -> "), "ref_entity"), F.lit("")))).otherwise(""))
    lines = erd.attributes.groupBy("entity", "epos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("apos", mark.alias("m")))), lambda x: x["m"]), ", ").alias("list"))
    entities = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("epos", F.concat("entity", F.lit(": "), "list").alias("l")))), lambda x: x["l"]), "\n").alias("entities"))
    rel = F.concat_ws(" ", F.concat("from_entity", F.lit(" ("), "from_cardinality", F.lit(")")), F.lit("--"), F.concat("to_entity", F.lit(" ("), "to_cardinality", F.lit(")")), F.concat(F.lit("via "), "fk_attribute"))
    relations = erd.relationships.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rpos", rel.alias("l")))), lambda x: x["l"]), "\n").alias("relations"))
    return entities.crossJoin(relations).select(F.concat(F.lit("Entities:\n"), "entities", F.lit("\nRelationships:\n"), "relations").alias("text"))


def ontology_text(concepts: DataFrame, attributes: DataFrame, label: str) -> DataFrame:
    """(text): a block for each concept with its properties and relations."""
    line = F.concat(F.lit("  - "), "source", F.lit(" -> "), "canonical", F.coalesce(F.concat(F.lit(" -> "), "target"), F.lit("")))
    lists = attributes.groupBy("concept").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("list"))
    block = F.concat("concept", F.lit(" ("), "category", F.lit(") from "), "source", F.coalesce(F.concat(F.lit("\n"), "list"), F.lit("")))
    blocks = concepts.join(lists, "concept", "left").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n").alias("blocks"))
    return blocks.select(F.concat(F.lit(f"Ontology {label}:\n"), "blocks").alias("text"))
