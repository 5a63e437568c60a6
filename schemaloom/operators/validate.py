"""Checks of a model against the tables it should describe: attributes, relationships, normal form."""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.names import trimmed_key
from schemaloom.operators import fds
from schemaloom.operators.cover import cover, group_counts, unique_sets
from schemaloom.operators.model import CARDINALITIES, Erd
from schemaloom.operators.sampling import aligned
from schemaloom.operators.scores import set_scores

#: Largest candidate key that is looked for, and the parts of the total score.
KEY_SIZE = 4
WEIGHTS = {"precision": 0.35, "recall": 0.35, "relationships": 0.2, "normal_form": 0.1}


def relationship_checks(erd: Erd) -> DataFrame:
    """(rpos, from_entity, to_entity, fk_attribute, pk_attribute, expected_fk_entity, expected_pk_entity, issues array, valid)."""
    names = F.broadcast(erd.entities.select(F.col("entity").alias("name")).distinct())
    held = erd.attributes.select("entity", trimmed_key("attr").alias("attr")).distinct()
    r, c = erd.relationships, F.col
    for side in ("from", "to"):
        r = r.join(names.select(c("name").alias(f"{side}_entity"), F.lit(True).alias(f"{side}_known")), f"{side}_entity", "left")
        for key in ("fk", "pk"):
            own = held.select(c("entity").alias(f"{side}_entity"), c("attr").alias(f"_{key}"), F.lit(True).alias(f"{key}_in_{side}"))
            r = r.withColumn(f"_{key}", trimmed_key(f"{key}_attribute")).join(F.broadcast(own), [f"{side}_entity", f"_{key}"], "left")
    r = r.na.fill(False, [x for s in ("from", "to") for x in (f"{s}_known", f"fk_in_{s}", f"pk_in_{s}")])
    many = lambda s: F.contains(F.coalesce(c(f"{s}_cardinality"), F.lit("")), F.lit("N"))
    one_sided = many("from") != many("to")
    fk_side = F.when(one_sided, F.when(many("from"), "from").otherwise("to"))
    pk_side = F.when(one_sided, F.when(many("from"), "to").otherwise("from"))

    def key_issue(key: str, side) -> Any:
        inside = {s: c(f"{key}_in_{s}") for s in ("from", "to")}
        blank = F.coalesce(c(f"{key}_attribute"), F.lit("")) == ""
        wrong = F.when(side == "from", ~inside["from"] & inside["to"]).when(side == "to", ~inside["to"] & inside["from"]).otherwise(False)
        return F.when(blank, f"{key}_attribute_missing").when(wrong, f"{key}_on_wrong_entity").when(~inside["from"] & ~inside["to"], f"{key}_attribute_missing")

    issues = F.array_compact(F.array(
        F.when(~c("from_known"), "from_entity_missing"), F.when(~c("to_known"), "to_entity_missing"),
        *[F.when(~F.coalesce(c(f"{s}_cardinality"), F.lit("")).isin(*CARDINALITIES), f"invalid_{s}_cardinality") for s in ("from", "to")],
        F.when(many("from") & many("to"), "many_to_many_requires_bridge"), key_issue("fk", fk_side), key_issue("pk", pk_side),
    ))
    entity = lambda side: F.when(side == "from", c("from_entity")).when(side == "to", c("to_entity"))
    out = r.select("rpos", "from_entity", "to_entity", "fk_attribute", "pk_attribute", entity(fk_side).alias("expected_fk_entity"), entity(pk_side).alias("expected_pk_entity"), issues.alias("issues"))
    return out.withColumn("valid", F.size("issues") == 0)


def _unique(counts: tuple[int, ...]) -> bool:
    """Whether some rows have no null in a set of columns and none of these repeats another, by ``group_counts``."""
    return 0 < counts[0] == counts[1]


def entity_profile(df: DataFrame, attributes: list[str], primary: list[str]) -> dict[str, Any]:
    """Issues of one entity in its table: missing or unfit key, partial and transitive dependencies, violations of the third normal form.

    Rows are taken as they are, copies included. All tests count groups of one cover of the columns, which is written once, a
    few batches of them for each kind; loops go over names.
    """
    present, missing = aligned(df, attributes)
    pk, pk_missing = aligned(df, primary)
    if not primary:
        return {"issues": ["missing_primary_key"], "candidate_keys": [], "fds": []}
    issues = [f"pk_missing_columns:{','.join(pk_missing)}"] if pk_missing else []
    looked = present or df.columns
    every = [*looked, *(c for c in pk if c not in looked)]
    held, places = cover(df, every), {c: i for i, c in reversed(list(enumerate(every)))}
    at = lambda names: tuple(places[c] for c in names)
    found = [tuple(every[i] for i in k) for k in unique_sets(held, KEY_SIZE, lenient=True, among=range(len(looked)))]
    prime = {a for k in found for a in k}
    subsets = [s for size in range(1, len(pk)) for s in combinations(pk, size)]
    others = [a for a in present if a not in pk]
    tested = [tuple(pk), *subsets] if pk else []
    counts = group_counts(held, [at(s) for s in tested], at(others))
    unique = {s: _unique(counts[at(s)]) for s in tested}
    if pk and not unique[tuple(pk)]:
        issues.append("pk_not_unique")
    issues += [f"pk_not_minimal:{'+'.join(s)}" for s in subsets if unique[s]][:1]
    if pk and others:
        depends = {(s, a) for s in tested for a, n in zip(others, counts[at(s)][2:], strict=True) if n and n == counts[at(s)][0] and counts[at(s)][1] / held.rows >= fds.SUPPORT}
        issues += [f"non_key_not_dependent_on_pk:{a}" for a in others if (tuple(pk), a) not in depends]
        issues += [f"partial_dependency:{'+'.join(s)}->{a}" for s in subsets for a in others if (s, a) in depends]
    else:
        depends = set()
    rules = sorted([(tuple(x), y) for x, y, *_ in fds.rules_of(held, present[: fds.ATTRIBUTES])], key=lambda r: (len(r[0]), r)) if present else []
    issues += [f"3nf_violation:{'+'.join(x)}->{y}" for x, y in rules if y not in prime]  # no left side is a key, as its groups are at most NEAR_UNIQUE of its rows
    issues += [f"transitive_dependency:{'+'.join(x)}->{y}" for x, y in rules if pk and y in others and x[0] in others and (tuple(pk), x[0]) in depends]
    return {"issues": issues, "candidate_keys": [list(k) for k in found], "fds": rules, "attributes_missing": missing}


def best_table(tables: dict[str, DataFrame], attributes: list[str]) -> str | None:
    """The table with most of the attributes; the first of several."""
    counts = [(len(aligned(df, attributes)[0]), -i, n) for i, (n, df) in enumerate(tables.items())]
    return max(counts)[2] if counts and max(counts)[0] else None


def normal_form_checks(tables: dict[str, DataFrame], erd: Erd) -> DataFrame:
    """(entity, tbl, valid, issues) of each entity against the table that fits it best."""
    spark = erd.entities.sparkSession
    attrs = {r[0]: r[1] for r in erd.attributes.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("apos", "attr"))), lambda x: x["attr"])).collect()}
    rows = []
    for e in erd.entities.orderBy("epos").collect():
        mine = attrs.get(e["entity"], [])
        tbl = best_table(tables, mine)
        issues = entity_profile(tables[tbl], mine, list(e["primary_key"]))["issues"] if tbl else ["no_matching_table"]
        rows.append((e["entity"], tbl, not issues, issues))
    return spark.createDataFrame(rows, "entity string, tbl string, valid boolean, issues array<string>")


def issue_counts(checks: DataFrame) -> DataFrame:
    """(code, n) of the issues by what stands before their colon."""
    return checks.select(F.explode("issues").alias("i")).groupBy(F.substring_index("i", ":", 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def validate(tables: dict[str, DataFrame], erd: Erd) -> DataFrame:
    """One row: precision and recall of the attributes against the tables' columns, shares of valid relationships and entities, total."""
    spark = erd.entities.sparkSession
    columns = spark.createDataFrame([(c,) for df in tables.values() for c in df.columns], "c string").select(trimmed_key("c").alias("k"))
    row = set_scores(erd.attributes.select(trimmed_key("attr").alias("k")), columns, "k")
    row = row.withColumn("precision", F.when(F.col("true_positives") + F.col("false_positives") == 0, 0.0).otherwise(F.col("precision")))
    some = 0.0 if erd.entities.isEmpty() else 1.0
    part = lambda df, n: F.broadcast(df.agg(F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(some)).alias(n)))
    row = row.drop("f1").crossJoin(part(relationship_checks(erd), "relationships")).crossJoin(part(normal_form_checks(tables, erd), "normal_form"))
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return row.withColumn("total", total)
