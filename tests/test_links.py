"""Foreign keys by sketches against the way over all values; sketches never refute an inclusion; hooks are the names' rule."""

import random

from pyspark.sql import functions as F

from schemaloom.operators import inds, keys, links
from schemaloom.operators import profile as prof


def by_values(tables):
    index = inds.table_index(tables)
    profiles = prof.profiles(tables, index)
    single = keys.single_keys(profiles)
    edges = inds.foreign_keys(inds.inclusions_of(index), profiles, single, {n: i for i, n in enumerate(tables)})
    return inds.without_reciprocals(edges, keys.primary_keys(single))


def drawn(spark, rng):
    size = lambda: rng.choice((1, 2, 3, 40, 3000, 9000))
    out = {}
    keys_of = {"Branch": size(), "LoanOfficer": size(), "Account": size()}
    for name, n in keys_of.items():
        row = F.col("id")
        columns = [row.alias(f"{name.lower()}_code"), F.concat(F.lit("n"), row % rng.choice((1, 7, n))).alias("name")]
        for other, m in keys_of.items():
            if other != name:
                value = (row * 7) % (m + rng.choice((0, 0, 1)))
                columns.append(F.when(row % rng.choice((2, 10**9)) != 1, value).cast(rng.choice(("long", "string"))).alias(rng.choice((f"{other.lower()}_code", f"{other}", f"main_{other.lower()}_code", f"other {other}"))))
        columns.append(F.when(row < 0, "x").alias("empty"))
        out[name] = spark.range(n).select(*columns)
    out["None"] = spark.createDataFrame([], "branch_code long, `odd.name` string")
    return out


def test_links_are_those_of_all_values(spark):
    for seed in range(2):
        tables = drawn(spark, random.Random(seed))
        assert sorted(map(tuple, links.links(tables).collect())) == sorted(map(tuple, by_values(tables).collect()))


def test_sketches_refute_no_inclusion(spark):
    for seed in (11,):
        tables = drawn(spark, random.Random(seed))
        sketches = links.column_sketches(tables)
        side = lambda n: sketches.select(F.struct(*sketches.columns).alias(n))
        refuted = {tuple(r) for r in side("c").crossJoin(side("p")).filter(links.refuted("c", "p")).select("c.tbl", "c.col", "p.tbl", "p.col").collect()}
        found = inds.inclusions(tables).collect()
        held = {(r.child_tbl, r.child_col, r.parent_tbl, r.parent_col) for r in found if r.coverage == 1}
        assert held and not held & refuted
        assert len(refuted) > 5


def test_hooks_are_the_rule_of_names(spark):
    names = ["branch_code", "Branch", "branchcode", "main_branch_code", "code", "loan_officer", "id", "key", "main_key", "a__b", "b", "_b", "", "xbranch"]
    tables = ["Branches", "Branch", "LoanOfficer", "B", "Ids"]
    child = spark.createDataFrame([(n,) for n in names], "col string").select(F.struct("col").alias("child"))
    parent = spark.createDataFrame([(t, n) for t in tables for n in names], "tbl string, col string").select(F.struct("tbl", "col").alias("parent"))
    want = {tuple(r) for r in child.crossJoin(parent).filter(inds.names_agree(F.col("child.col"), F.col("parent.tbl"), F.col("parent.col"))).select("child.col", "parent.tbl", F.col("parent.col").alias("x")).collect()}
    got = child.withColumn("hook", F.explode(links._hooks(True))).join(parent.withColumn("hook", F.explode(links._hooks(False))), "hook").select("child.col", "parent.tbl", F.col("parent.col").alias("x"))
    assert {tuple(r) for r in got.distinct().collect()} == want and len(want) > 20


def test_a_sample_meets_repeated_values(spark, monkeypatch):
    monkeypatch.setattr(links, "CELLS", 500)
    tables = {"T": spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 1500).alias("twice"), F.greatest(F.col("id"), F.lit(1)).alias("once"))}
    facts = links.column_sketches(tables).drop("sketch").collect()
    assert links.unique_columns(tables, facts) == {("T", "key")}
