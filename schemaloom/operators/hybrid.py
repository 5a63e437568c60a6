"""A proposed model hardened with the facts of the data-derived one: types, keys, columns and foreign keys, with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.names import bare_key, unordered_pair
from schemaloom.operators.model import Erd

DATA, PROPOSED = "deterministic", "llm"


def pure(base: Erd) -> Erd:
    """The data-derived model alone, marked as such."""
    mark = lambda df, *c: df.withColumns({x: F.lit(DATA) for x in c})
    return Erd(mark(base.entities, "name_prov", "pk_prov"), mark(base.attributes, "prov"), mark(base.relationships, "prov"))


def facts(base: Erd) -> DataFrame:
    """(key, col_type, any_type, name, epos, apos): each column of the data; col_type only if all its occurrences agree."""
    rows = base.attributes.withColumns({"key": bare_key("attr"), "at": F.struct("epos", "apos")})
    known = F.col("data_type").isNotNull()
    out = rows.groupBy("key").agg(F.count_distinct("data_type").alias("n"), F.min_by("data_type", F.when(known, F.col("at"))).alias("any_type"), F.min_by("attr", "at").alias("name"), F.min("at").alias("at"))
    return out.select("key", F.when(F.col("n") == 1, F.col("any_type")).alias("col_type"), "any_type", "name", F.col("at.epos").alias("epos"), F.col("at.apos").alias("apos"))


def _injective(entities: DataFrame) -> DataFrame:
    """entities with final, a name that no other has: repeated ones get a number."""
    same = Window.partitionBy(bare_key("entity")).orderBy("epos")
    n = F.row_number().over(same)
    return entities.withColumn("final", F.when(n > 1, F.concat_ws(" ", "entity", n.cast("string"))).otherwise(F.col("entity")))


def merge(base: Erd, proposal: Erd) -> Erd:
    """The proposal's entities with the data's types; columns it left out go to the entity that shares most with their
    home in the data (then the larger, then the first), one after another; its relationships and the data's foreign keys it missed.
    """
    if proposal.entities.isEmpty():
        return pure(base)
    known = facts(base)
    named = _injective(proposal.entities)
    final = F.broadcast(named.select("epos", "final"))
    typed = proposal.attributes.join(final, "epos").withColumn("key", bare_key("attr")).join(known.select("key", "col_type"), "key", "left")
    attrs = typed.select(F.col("final").alias("entity"), "epos", "attr", "apos", F.coalesce("col_type", "data_type").alias("data_type"), "is_pk", "is_fk", "ref_entity", "ref_col", "nullable", F.when(F.col("col_type").isNotNull(), DATA).otherwise(PROPOSED).alias("prov"), "key")
    verified = base.entities.select(F.explode("primary_key").alias("k")).select(bare_key("k").alias("key")).distinct()
    pks = proposal.entities.select("epos", F.explode("primary_key").alias("k")).select("epos", bare_key("k").alias("key"))
    bad = pks.join(verified, "key", "left_anti").select("epos").distinct().withColumn("bad", F.lit(True))
    entities = named.join(bad, "epos", "left").select(F.col("final").alias("entity"), "epos", "primary_key", F.lit(PROPOSED).alias("name_prov"), F.when((F.size("primary_key") > 0) & F.col("bad").isNull(), DATA).otherwise(PROPOSED).alias("pk_prov"))

    missing = known.join(attrs.select("key").distinct(), "key", "left_anti")
    spots = {r["epos"]: r["final"] for r in named.orderBy("epos").collect()}
    held: dict[int, set[str]] = {e: set() for e in spots}
    for r in attrs.select("epos", "key").collect():
        held[r["epos"]].add(r["key"])
    homes: dict[int, set[str]] = {}
    for r in base.attributes.select("epos", bare_key("attr").alias("key")).collect():
        homes.setdefault(r["epos"], set()).add(r["key"])
    where = []
    for r in missing.orderBy("epos", "apos").collect():  # names only; a column that is placed draws the next ones of its home
        target = max(spots, key=lambda e: (len(held[e] & homes[r["epos"]]), len(held[e]), -e))
        held[target].add(r["key"])
        where.append((r["key"], target, spots[target]))
    spark = base.entities.sparkSession
    placed = missing.select("key", "name", "col_type", "any_type", F.col("epos").alias("home_pos"), F.col("apos").alias("home_apos")).join(spark.createDataFrame(where, "key string, target int, final string"), "key")
    after = F.row_number().over(Window.partitionBy("target").orderBy("home_pos", "home_apos")) + 100_000
    no = F.lit(None).cast("string")
    filled = placed.select(F.col("final").alias("entity"), F.col("target").alias("epos"), F.col("name").alias("attr"), after.alias("apos"), F.coalesce("col_type", "any_type", F.lit("string")).alias("data_type"), F.lit(False).alias("is_pk"), F.lit(False).alias("is_fk"), no.alias("ref_entity"), no.alias("ref_col"), F.lit(None).cast("boolean").alias("nullable"), F.lit(DATA).alias("prov"), "key")
    attrs = attrs.unionByName(filled)

    once = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(bare_key("entity")))).filter("n = 1").select(bare_key("entity").alias("k"), "final")
    whole = named.select(bare_key("final").alias("k"), "final")
    label = once.union(whole.join(once, "k", "left_anti"))
    end = lambda side: F.broadcast(label.select(F.col("k").alias(f"{side}_k"), F.col("final").alias(f"{side}_final")))
    base_keys = base.relationships.filter("fk_attribute is not null").select(bare_key("fk_attribute").alias("fk")).distinct().withColumn("seen", F.lit(True))
    rels = proposal.relationships.withColumns({"from_k": bare_key("from_entity"), "to_k": bare_key("to_entity"), "fk": bare_key("fk_attribute")}).join(end("from"), "from_k").join(end("to"), "to_k").join(base_keys, "fk", "left")
    pair = unordered_pair(bare_key("from_final"), bare_key("to_final"))
    first = F.row_number().over(Window.partitionBy(pair, "fk").orderBy("rpos"))
    rels = rels.withColumn("pair", pair).withColumn("r", first).filter("fk = '' or r = 1")
    columns = ["rpos", "from_entity", "to_entity", "from_cardinality", "to_cardinality", "fk_attribute", "pk_attribute", "prov"]
    own = rels.select("pair", "fk", "rpos", F.col("from_final").alias("from_entity"), F.col("to_final").alias("to_entity"), F.coalesce("from_cardinality", F.lit("0..N")).alias("from_cardinality"), F.coalesce("to_cardinality", F.lit("1")).alias("to_cardinality"), "fk_attribute", "pk_attribute", F.when(F.col("seen"), DATA).otherwise(PROPOSED).alias("prov"))

    holders = attrs.select("key", "epos", "entity").distinct()
    pk_of = entities.select("epos", F.explode("primary_key").alias("k")).select("epos", bare_key("k").alias("key")).distinct().withColumn("in_pk", F.lit(True))
    parents = holders.join(pk_of, ["key", "epos"], "left").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("in_pk", F.lit(False)).desc(), "epos"))).filter("r = 1").select(F.col("key").alias("pk"), F.col("epos").alias("parent"), F.col("entity").alias("to_entity"))
    links = base.relationships.filter("fk_attribute is not null").select("rpos", "fk_attribute", "pk_attribute", bare_key("fk_attribute").alias("fk"), bare_key("pk_attribute").alias("pk"), "from_cardinality", "to_cardinality", bare_key("from_entity").alias("source"))
    children = links.join(parents, "pk").join(holders.select(F.col("key").alias("fk"), F.col("epos").alias("child"), F.col("entity").alias("from_entity")), "fk").filter("child <> parent")
    source = base.attributes.select(bare_key("entity").alias("source"), bare_key("attr").alias("shared")).distinct()
    near = children.select("rpos", "child", "source").join(source, "source").join(holders.select(F.col("key").alias("shared"), F.col("epos").alias("child")), ["child", "shared"]).groupBy("rpos", "child").agg(F.count_distinct("shared").alias("near"))
    children = children.join(near, ["rpos", "child"], "left").join(pk_of.select(F.col("key").alias("fk"), F.col("epos").alias("child"), "in_pk"), ["fk", "child"], "left")
    pick = Window.partitionBy("rpos").orderBy(F.coalesce("in_pk", F.lit(False)), F.coalesce("near", F.lit(0)).desc(), "child")
    children = children.withColumn("r", F.row_number().over(pick)).filter("r = 1").withColumn("pair", unordered_pair(bare_key("from_entity"), bare_key("to_entity")))
    new = children.join(own.select("pair", "fk").distinct(), ["pair", "fk"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("pair", "fk").orderBy("rpos"))).filter("r = 1")
    added = new.select((F.col("rpos") + 100_000).alias("rpos"), "from_entity", "to_entity", F.coalesce("from_cardinality", F.lit("0..N")).alias("from_cardinality"), F.coalesce("to_cardinality", F.lit("1")).alias("to_cardinality"), "fk_attribute", "pk_attribute", F.lit(DATA).alias("prov"))
    return Erd(entities, attrs.drop("key"), own.select(*columns).unionByName(added))
