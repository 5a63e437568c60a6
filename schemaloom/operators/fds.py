"""Functional dependencies: single tests, strength and support, search."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators.common import scalar
from schemaloom.operators.cover import Cover, bits, cover, determining, group_counts
from schemaloom.operators.keys import _gid

#: Least rows, attributes looked at, largest left side, least support, and the share of different values from which a left side says nothing.
LEAST_ROWS, ATTRIBUTES, LEFT, SUPPORT, NEAR_UNIQUE = 12, 12, 3, 0.9, 0.9
#: Left sides that are tested in one pass over the table.
BATCH = 32


def _one_value(df: DataFrame, c: str) -> Column:
    """Whether a group holds one value of c, null counting as a value; needs no distinct aggregation.

    Of texts 128 bits of hashes are compared, as Spark sorts all rows where an aggregate isn't of fixed size.
    """
    x = F.col(f"`{c}`")
    parts = [F.xxhash64(x), F.xxhash64(F.lit(1), x)] if df.select(x).schema[0].dataType in (T.StringType(), T.BinaryType()) else [x]
    one = (F.count(x) == 0) | (F.count(x) == F.count(F.lit(1)))
    for p in parts:
        one = one & F.min(p).eqNullSafe(F.max(p))
    return one


def determines(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, col, holds): whether each non-null key has one value of col, null counting as a value. No key at all: false."""
    base = scalar(df)
    groups = base.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(*[_one_value(base, c).alias(f"ok{i}") for i, c in enumerate(columns)])
    row = groups.agg(*[F.coalesce(F.bool_and(f"ok{i}"), F.lit(False)).alias(f"ok{i}") for i in range(len(columns))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.lit(c).alias("col"), F.col(f"ok{i}").alias("holds")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def strengths(df: DataFrame, lefts: Sequence[Sequence[str]], rights: Sequence[str]) -> DataFrame:
    """(lhs, rhs, strength, support_ratio, row_count, n_groups, full_rows) for each left side and each other column.

    Rows with a null in the left side are left out; strength: share of its groups with one value of rhs, null counting
    as a value; support: the share of rows that remain. All left sides of a batch are grouped in one pass.
    """
    schema = "lhs array<string>, rhs string, strength double, support_ratio double, row_count long, n_groups long, full_rows long"
    every = list(dict.fromkeys([*(c for x in lefts for c in x), *rights]))
    number = {c: i for i, c in enumerate(every)}  # columns are numbered, so that no name clashes
    base = scalar(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(every)]))
    copies = base.select("*", *[F.col(f"c{number[c]}").alias(f"v{k}") for k, c in enumerate(rights)])
    out = None
    for at in range(0, len(lefts), BATCH):
        part = [tuple(x) for x in lefts[at : at + BATCH]]
        columns = sorted({f"c{number[c]}" for x in part for c in x})
        missing = F.lit(False)
        for c in columns:
            missing = missing | (F.grouping(c) == 0) & F.col(c).isNull()
        sets = [[f"c{number[c]}" for c in x] for x in part]
        groups = copies.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("gid"), missing.alias("missing"), F.count(F.lit(1)).alias("cnt"), *[_one_value(copies, f"v{k}").alias(f"ok{k}") for k in range(len(rights))])
        full = ~F.col("missing")
        sums = groups.groupBy("gid").agg(F.sum("cnt").alias("row_count"), F.count_if(full).alias("n_groups"), F.sum(F.when(full, F.col("cnt")).otherwise(0)).alias("full_rows"), *[F.count_if(full & F.col(f"ok{k}")).alias(f"n{k}") for k in range(len(rights))])
        label = F.create_map(*[x for c, s in zip(part, sets, strict=True) for x in (F.lit(_gid(s, columns)).cast("long"), F.array(*map(F.lit, c)))])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("rhs"), F.col(f"n{k}").alias("ok")) for k, c in enumerate(rights)]))
        rows = sums.select(label[F.col("gid")].alias("lhs"), each.alias("x"), "row_count", "n_groups", "full_rows").filter(~F.array_contains("lhs", F.col("x.rhs")))
        strength = F.when(F.col("n_groups") == 0, F.lit(0.0)).otherwise(F.col("x.ok") / F.col("n_groups"))
        rows = rows.select("lhs", F.col("x.rhs").alias("rhs"), strength.alias("strength"), F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.col("full_rows") / F.col("row_count")).alias("support_ratio"), "row_count", "n_groups", "full_rows")
        out = rows if out is None else out.unionByName(rows)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def holding(found: DataFrame) -> DataFrame:
    """Those that hold in every group and have enough support."""
    return found.filter((F.col("strength") >= 1) & (F.col("support_ratio") >= SUPPORT))


def discover(df: DataFrame, columns: Sequence[str] | None = None, left: int = LEFT, attributes: int = ATTRIBUTES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lhs, rhs, strength, support_ratio, row_count) of the dependencies that hold, not only minimal ones.

    Left sides of up to ``left`` of the first ``attributes`` columns; one whose values nearly all differ is left out, as
    is a table of fewer than ``least_rows`` rows. The least left sides come from ``cover``; what holds for them holds for all
    that contain them, and these are counted only, unless they contain one that was left out and has no nulls.
    """
    columns = list(columns or df.columns)[:attributes]
    schema = "lhs array<string>, rhs string, strength double, support_ratio double, row_count long"
    empty = df.sparkSession.createDataFrame([], schema)
    if len(columns) < 2:
        return empty
    rows = rules_of(cover(df, columns), columns, left, least_rows)
    return df.sparkSession.createDataFrame(rows, schema) if rows else empty


def rules_of(held: Cover, columns: Sequence[str], left: int = LEFT, least_rows: int = LEAST_ROWS) -> list[tuple[list[str], str, float, float, int]]:
    """The rows of ``discover`` for the columns, which are the first of what ``held`` covers."""
    places = range(len(columns))
    if len(columns) < 2 or held.rows < least_rows or not held.rows:
        return []
    rules = {t: [bits(c) for c in lefts] for t, lefts in determining(held, places, places, left).items()}
    rows, dropped = [], []
    for size in range(1, min(left, len(columns) - 1) + 1):
        holds: dict[tuple[int, ...], list[int]] = {}
        for c in combinations(places, size):
            m = bits(c)
            if any(d & m == d for d in dropped) and not any(held.nulls[i] for i in c):
                continue
            if rights := [t for t in places if t not in c and any(k & m == k for k in rules[t])]:
                holds[c] = rights
        for c, (groups, full) in group_counts(held, list(holds)).items():
            if groups > full * NEAR_UNIQUE:
                if not any(held.nulls[i] for i in c):
                    dropped.append(bits(c))
                continue
            if groups and full >= held.rows * SUPPORT:
                rows += [([columns[i] for i in c], columns[t], 1.0, full / held.rows, held.rows) for t in holds[c]]
    return rows
