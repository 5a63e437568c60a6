"""Inclusion dependencies and the foreign keys that follow: coverage, name and type gates, choice, cardinalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.names import GENERIC_KEYS, bare_key, chopped, plain_tokens, unordered_pair
from schemaloom.operators.common import cells, checkpointed

#: Least different values on both sides, least coverage.
DISTINCT, COVERAGE = 2, 1.0


def table_index(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, col, pos, value, cnt): how often each value of each column of all tables occurs, long texts by digest, written once; what profiles, keys and inclusions are made from."""
    index = None
    for tbl, df in tables.items():
        part = cells(df, digests=True).groupBy(F.lit(tbl).alias("tbl"), "col", "pos", "value").agg(F.count(F.lit(1)).alias("cnt"))
        index = part if index is None else index.unionByName(part)
    return checkpointed(index)


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """``inclusions_of`` the tables' common index."""
    return inclusions_of(table_index(tables))


def inclusions_of(index: DataFrame) -> DataFrame:
    """(child_tbl, child_col, parent_tbl, parent_col, shared, child_distinct, parent_distinct, coverage) of all pairs of columns of different tables that share a value.

    index: ``table_index``, dealt out by value. Values are first counted by the set of columns that hold them; pairs of
    columns are made once for each different set, of which there are few, however many values there are.
    """
    index = index.filter(F.col("value").isNotNull()).select(F.struct("tbl", "col", "pos").alias("ref"), "value")
    sets = index.groupBy("value").agg(F.sort_array(F.collect_set("ref")).alias("refs")).groupBy("refs").agg(F.count(F.lit(1)).alias("values"))
    pairs = sets.select(F.explode("refs").alias("child"), "refs", "values").select("child", F.explode("refs").alias("parent"), "values")
    counted = pairs.groupBy("child", "parent").agg(F.sum("values").alias("shared"))
    own = counted.filter("child = parent").select(F.col("child").alias("ref"), F.col("shared").alias("size"))
    sides = lambda name: F.broadcast(own.select(F.col("ref").alias(name), F.col("size").alias(f"{name}_distinct")))  # noqa: E731  a row for each column
    out = counted.filter("child.tbl <> parent.tbl").join(sides("child"), "child").join(sides("parent"), "parent")
    return out.select(
        F.col("child.tbl").alias("child_tbl"), F.col("child.col").alias("child_col"), F.col("child.pos").alias("child_pos"),
        F.col("parent.tbl").alias("parent_tbl"), F.col("parent.col").alias("parent_col"), F.col("parent.pos").alias("parent_pos"),
        "shared", "child_distinct", "parent_distinct", (F.col("shared") / F.col("child_distinct")).alias("coverage"),
    )


def names_agree(child_col: Column, parent_tbl: Column, parent_key: Column) -> Column:
    """Whether a column's name points at a table: it is the key's name; or holds the table's name; or ends in the key's name, if that says more than "id"."""
    words, raw = plain_tokens(child_col), F.lower(child_col)
    name, key = chopped(bare_key(parent_tbl)), bare_key(parent_key)
    ends = lambda x: F.endswith(raw, F.concat(F.lit("_"), x))
    by_table = (name != "") & (F.array_contains(words, name) | ends(name))
    by_key = (key != "") & ~key.isin(*GENERIC_KEYS) & ((F.get(F.reverse(words), F.lit(0)) == key) | ends(key))
    return (bare_key(child_col) == key) | by_table | F.coalesce(by_key, F.lit(False))


def types_agree(a: Column, b: Column) -> Column:
    """Text goes with everything, whole numbers with all numbers, other types with themselves."""
    broad = lambda t: F.when(t.isin("integer", "float"), "numeric").otherwise(t)
    return (a == "string") | (b == "string") | (broad(a) == broad(b))


def foreign_keys(found: DataFrame, profiles: DataFrame, keys: DataFrame, table_order: dict[str, int]) -> DataFrame:
    """(from_entity, to_entity, from_cardinality, to_cardinality, fk_attribute, pk_attribute): each column's best parent.

    found: inclusions(); profiles: (tbl, col, type, null_ratio, distinct_cnt, n, is_unique); keys: (tbl, key_cols, size).
    The parent side must be a single-column key. Of several parents the greatest coverage wins, then the first.
    Metadata is a row for each column, so it is broadcast.
    """
    single = F.broadcast(keys.filter("size = 1").select(F.col("tbl").alias("parent_tbl"), F.get("key_cols", F.lit(0)).alias("parent_col"), F.col("pos").alias("key_pos")))
    of = lambda side: F.broadcast(profiles.select(F.col("tbl").alias(f"{side}_tbl"), F.col("col").alias(f"{side}_col"), F.col("type").alias(f"{side}_type"), F.col("null_ratio").alias(f"{side}_nulls"), F.col("is_unique").alias(f"{side}_unique")))
    place = F.create_map(*[x for t, i in table_order.items() for x in (F.lit(t), F.lit(i))])
    fit = found.filter((F.col("coverage") >= COVERAGE) & (F.col("child_distinct") >= DISTINCT) & (F.col("parent_distinct") >= DISTINCT))
    fit = fit.join(single, ["parent_tbl", "parent_col"]).filter(names_agree(F.col("child_col"), F.col("parent_tbl"), F.col("parent_col")))
    fit = fit.join(of("child"), ["child_tbl", "child_col"]).join(of("parent"), ["parent_tbl", "parent_col"]).filter(types_agree(F.col("child_type"), F.col("parent_type")))
    best = Window.partitionBy("child_tbl", "child_col").orderBy(F.col("coverage").desc(), place[F.col("parent_tbl")], "key_pos")
    fit = fit.withColumn("r", F.row_number().over(best)).filter("r = 1")
    return fit.select(
        F.col("child_tbl").alias("from_entity"), F.col("parent_tbl").alias("to_entity"),
        F.when(F.col("child_unique"), "0..1").otherwise("0..N").alias("from_cardinality"), F.when(F.col("child_nulls") == 0, "1").otherwise("0..1").alias("to_cardinality"),
        F.col("child_col").alias("fk_attribute"), F.col("parent_col").alias("pk_attribute"),
        place[F.col("child_tbl")].alias("from_pos"), F.col("child_pos").alias("fk_pos"),
    )


def without_reciprocals(edges: DataFrame, primary: DataFrame) -> DataFrame:
    """One edge for each pair of tables and column: first those whose column is the parent's key and not the child's, in input order, else by the names. primary: (tbl, key_cols)."""
    side = lambda name: F.broadcast(primary.select(F.col("tbl").alias(f"{name}_entity"), F.col("key_cols").alias(f"{name}_pk")))
    both = edges.join(side("from"), "from_entity", "left").join(side("to"), "to_entity", "left")
    holds = lambda name: F.coalesce(F.array_contains(f"{name}_pk", F.col("fk_attribute")), F.lit(False))
    preferred = holds("to") & ~holds("from")
    order = [preferred.desc(), F.when(preferred, F.col("from_pos")), F.when(preferred, F.col("fk_pos")), "from_entity", "to_entity"]
    pair = Window.partitionBy(unordered_pair(F.col("from_entity"), F.col("to_entity")), "fk_attribute").orderBy(*order)
    return both.withColumn("r", F.row_number().over(pair)).filter("r = 1").select(*edges.columns)


def junctions(edges: DataFrame, primary: DataFrame) -> DataFrame:
    """(tbl) whose primary key is exactly two foreign keys."""
    held = edges.groupBy(F.col("from_entity").alias("tbl")).agg(F.collect_set("fk_attribute").alias("fks"))
    return primary.filter(F.size("key_cols") == 2).join(held, "tbl").filter(F.size(F.array_except("key_cols", "fks")) == 0).select("tbl")
