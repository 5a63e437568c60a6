"""Foreign keys of many tables by sketches first and values last.

One aggregation for each table gives a mergeable sketch of every column: the least hashes of its values (a theta sketch), the
least and greatest value, and counts. A column whose sketch holds a hash that another's lacks below their common bound is not
included in it, and a value that a sample meets twice rules out a key: what is refuted so is refuted for certain, and no value
has moved. Names are compared by an equi-join over what a column's name may point at. Only the columns of pairs that are left
send their different values through a shuffle, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.names import GENERIC_KEYS, bare_key, chopped, plain_tokens
from schemaloom.operators import keys
from schemaloom.operators.common import cells, checkpointed, scalar
from schemaloom.operators.inds import foreign_keys, without_reciprocals
from schemaloom.operators.profile import declared_type, profile

#: Log2 of the hashes that a sketch keeps; sketches that are merged first, before the last merge; cells that are looked at for repeated values.
KEPT, MERGED, CELLS = 11, 64, 1_000_000


def column_sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, col, pos, type, n, nulls, low, high, sketch) of every column, written; type is the declared one, null for text. Values are compared as texts."""
    out = None
    for tbl, df in tables.items():
        base = scalar(df).select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
        some = lambda i: (F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"l{i}"), F.max(f"c{i}").alias(f"h{i}"), F.theta_sketch_agg(f"c{i}", KEPT).alias(f"s{i}"))
        first = base.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("part")).agg(F.count(F.lit(1)).alias("rows"), *[x for i in range(len(df.columns)) for x in some(i)])
        last = lambda i, f: F.struct(F.lit(f.name).alias("col"), F.lit(i).alias("pos"), F.lit(declared_type(f.dataType)).cast("string").alias("type"), F.sum(f"n{i}").alias("full"), F.min(f"l{i}").alias("low"), F.max(f"h{i}").alias("high"), F.theta_union_agg(f"s{i}", KEPT).alias("sketch"))
        row = first.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.array(*[last(i, f) for i, f in enumerate(df.schema)]).alias("columns"))
        part = row.select(F.lit(tbl).alias("tbl"), "n", F.explode("columns").alias("c")).select("tbl", "c.col", "c.pos", "c.type", "n", (F.col("n") - F.coalesce("c.full", F.lit(0))).alias("nulls"), "c.low", "c.high", "c.sketch")
        out = part if out is None else out.unionByName(part)
    return checkpointed(out)


def refuted(child: str, parent: str) -> Column:
    """Whether the sketches show that a value of the child column is not in the parent column; never true of an inclusion."""
    outside = (F.col(f"{child}.low") < F.col(f"{parent}.low")) | (F.col(f"{child}.high") > F.col(f"{parent}.high"))
    return outside | (F.theta_sketch_estimate(F.theta_difference(F.col(f"{child}.sketch"), F.col(f"{parent}.sketch"))) > 0)


def unique_columns(tables: dict[str, DataFrame], facts: list) -> set[tuple[str, str]]:
    """(table, column) of the columns whose rows all have different values, none null. facts: (tbl, col, n, nulls, low, high) of each column."""
    mine = {t: [r.col for r in facts if r.tbl == t and r.n and not r.nulls and (r.n == 1 or r.low != r.high)] for t in tables}
    rows = {r.tbl: r.n for r in facts}
    drawn = None
    for tbl, df in tables.items():
        share = max(1, rows.get(tbl, 0) * len(mine[tbl]) // CELLS)
        if share > 1:  # a sample of all columns' values, by hash, with all rows of each of them
            cell = lambda c: F.struct(F.lit(tbl).alias("tbl"), F.lit(c).alias("col"), F.xxhash64(F.col(f"`{c}`")).alias("a"), F.xxhash64(F.lit(1), F.col(f"`{c}`")).alias("b"))  # noqa: B023, E731
            part = scalar(df).select(F.explode(F.filter(F.array(*[cell(c) for c in mine[tbl]]), lambda x: F.pmod(x["a"], F.lit(share)) == 0)).alias("x"))  # noqa: B023
            drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is not None:
        again = {tuple(r) for r in drawn.groupBy("x.tbl", "x.col", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tbl", "col").distinct().collect()}
        mine = {t: [c for c in columns if (t, c) not in again] for t, columns in mine.items()}
    tests = None
    for tbl, columns in mine.items():
        if columns:
            part = keys.key_tests(tables[tbl], [(c,) for c in columns]).filter("is_strict").select(F.lit(tbl).alias("tbl"), F.get("key_cols", F.lit(0)).alias("col"))
            tests = part if tests is None else tests.unionByName(part)
    return set() if tests is None else {tuple(r) for r in tests.collect()}


def _hooks(of_child: bool) -> Column:
    """What a child column's name may point at, or what points at a parent table and key: names agree (see ``inds.names_agree``) where a hook is the same."""
    mark = lambda kind, x: F.concat(F.lit(kind), x)
    if of_child:
        words, raw = plain_tokens(F.col("child.col")), F.lower("child.col")
        parts = F.split(raw, "_", -1)
        ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
        ends = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<string>"))
        last = F.coalesce(F.get(F.reverse(words), F.lit(0)), F.lit(""))
        return F.array_distinct(F.concat(F.array(mark("same ", bare_key("child.col")), mark("last ", last)), F.transform(words, lambda w: mark("word ", w)), F.transform(ends, lambda e: mark("end ", e))))
    name, key = chopped(bare_key("parent.tbl")), bare_key("parent.col")
    by_table = F.when(name != "", F.array(mark("word ", name), mark("end ", name))).otherwise(F.array().cast("array<string>"))
    by_key = F.when((key != "") & ~key.isin(*GENERIC_KEYS), F.array(mark("last ", key), mark("end ", key))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(mark("same ", key)), by_table, by_key))


def possible_links(sketches: DataFrame, unique: set[tuple[str, str]]) -> DataFrame:
    """(child, parent: structs of tbl, col, pos, type) of the pairs of columns whose names agree, whose parent is a key and which the sketches don't refute."""
    spark = sketches.sparkSession
    single = spark.createDataFrame(sorted(unique), "tbl string, col string")
    side = lambda name: F.struct("tbl", "col", "pos", "type", "low", "high", "sketch").alias(name)
    enough = sketches.filter(F.col("low") != F.col("high"))  # two values or more, as foreign_keys asks for
    child = enough.select(side("child")).withColumn("hook", F.explode(_hooks(True)))
    parent = enough.join(single, ["tbl", "col"], "left_semi").select(side("parent")).withColumn("hook", F.explode(_hooks(False)))
    names = child.select(F.col("child.tbl").alias("ct"), F.col("child.col").alias("cc"), "hook").join(parent.select(F.col("parent.tbl").alias("pt"), F.col("parent.col").alias("pc"), "hook"), "hook").filter("ct <> pt").select("ct", "cc", "pt", "pc").distinct()
    facts = lambda name, t, c: enough.select(F.col("tbl").alias(t), F.col("col").alias(c), side(name))
    both = names.join(facts("child", "ct", "cc"), ["ct", "cc"]).join(facts("parent", "pt", "pc"), ["pt", "pc"]).filter(~refuted("child", "parent"))
    plain = lambda name: F.struct(*[F.col(f"{name}.{x}").alias(x) for x in ("tbl", "col", "pos", "type")]).alias(name)
    return checkpointed(both.select(plain("child"), plain("parent")))


def verified(tables: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """The pairs with shared, child_distinct, parent_distinct and coverage (columns as of ``inds.inclusions``), by the different values of their columns."""
    sides = pairs.select("child.tbl", "child.col").union(pairs.select("parent.tbl", "parent.col")).distinct().collect()  # a row for each column that is left
    values = None
    for tbl, df in tables.items():
        mine = [r.col for r in sides if r.tbl == tbl]
        if mine:
            part = cells(df.select(*[F.col(f"`{c}`") for c in df.columns if c in mine]), digests=True).filter("value is not null").select(F.lit(tbl).alias("tbl"), "col", "value").distinct()
            values = part if values is None else values.unionByName(part)
    names = "child_tbl string, child_col string, child_pos int, parent_tbl string, parent_col string, parent_pos int, shared long, child_distinct long, parent_distinct long, coverage double"
    if values is None:
        return pairs.sparkSession.createDataFrame([], names)
    values = checkpointed(values)
    sizes = values.groupBy("tbl", "col").agg(F.count(F.lit(1)).alias("size"))
    flat = pairs.select(*[F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in ("child", "parent") for x in ("tbl", "col", "pos")])
    probes = values.withColumnsRenamed({"tbl": "child_tbl", "col": "child_col"}).join(F.broadcast(flat), ["child_tbl", "child_col"])  # metadata: pairs of columns
    shared = probes.join(values.withColumnsRenamed({"tbl": "parent_tbl", "col": "parent_col"}), ["parent_tbl", "parent_col", "value"]).groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("shared"))
    of = lambda s: sizes.withColumnsRenamed({"tbl": f"{s}_tbl", "col": f"{s}_col", "size": f"{s}_distinct"})
    out = shared.join(of("child"), ["child_tbl", "child_col"]).join(of("parent"), ["parent_tbl", "parent_col"])
    return checkpointed(out.select("child_tbl", "child_col", "child_pos", "parent_tbl", "parent_col", "parent_pos", "shared", "child_distinct", "parent_distinct", (F.col("shared") / F.col("child_distinct")).alias("coverage")))


def links(tables: dict[str, DataFrame]) -> DataFrame:
    """The foreign keys of tables (columns as of ``inds.foreign_keys``), one of each pair that point at each other, from sketches; the parents' keys are single columns."""
    spark = next(iter(tables.values())).sparkSession
    sketches = column_sketches(tables)
    facts = sketches.drop("sketch").orderBy("tbl", "pos").collect()  # a row for each column
    unique = unique_columns(tables, facts)
    found = verified(tables, possible_links(sketches, unique))
    texts = {(r[a], r[b]) for r in found.filter("coverage >= 1").collect() for a, b in (("child_tbl", "child_col"), ("parent_tbl", "parent_col"))} & {(r.tbl, r.col) for r in facts if r.type is None}
    kinds = {}
    for tbl, df in tables.items():
        if mine := [c for t, c in texts if t == tbl]:  # only texts that are in a pair still are judged by their values
            kinds |= {(tbl, r.col): r.type for r in profile(df.select(*[F.col(f"`{c}`") for c in mine])).select("col", "type").collect()}
    rows = [(r.tbl, r.col, r.type or kinds.get((r.tbl, r.col), "string"), r.nulls / r.n if r.n else 0.0, (r.tbl, r.col) in unique) for r in facts]
    profiles = spark.createDataFrame(rows, "tbl string, col string, type string, null_ratio double, is_unique boolean")
    order = {n: i for i, n in enumerate(tables)}
    single = [r for r in facts if (r.tbl, r.col) in unique]
    key_rows = spark.createDataFrame([(r.tbl, [r.col], 1, i) for i, r in enumerate(single)], "tbl string, key_cols array<string>, size int, pos int")
    edges = foreign_keys(found, profiles, key_rows, order)
    return without_reciprocals(edges, keys.primary_keys(key_rows))

