"""Unique column combinations: tests, candidate keys, the choice of a primary key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.operators.common import scalar
from schemaloom.operators.cover import cover, unique_sets

#: Column combinations that are tested in one pass over the table.
BATCH = 32
#: Fixed value: names of columns that look like keys.
KEY_NAME = r"(?i)(^id$|_id$|_key$|^key$|_code$|^code$)"


def _gid(combo: Sequence[str], columns: Sequence[str]) -> int:
    """Spark's grouping id: a bit for each column that is not grouped by, the first column highest."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in combo)


def key_tests(df: DataFrame, combos: Iterable[Sequence[str]]) -> DataFrame:
    """(key_cols, n, n_groups, full_rows, full_groups, is_strict, is_lenient) of each column combination.

    full: rows without a null in the combination. strict: no null and no repetition; lenient: no repetition among full
    rows; an empty table has no key. Combinations are counted by grouping sets, BATCH of them for each pass.
    """
    combos, out = [tuple(c) for c in combos], None
    every = list(dict.fromkeys(c for combo in combos for c in combo))
    base = scalar(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(every)]))  # numbered, so that no name clashes
    number = {c: f"c{i}" for i, c in enumerate(every)}
    for at in range(0, len(combos), BATCH):
        part = combos[at : at + BATCH]
        columns = sorted({number[c] for combo in part for c in combo})
        names = {_gid([number[c] for c in combo], columns): list(combo) for combo in part}
        missing = F.lit(False)
        for c in columns:
            missing = missing | (F.grouping(c) == 0) & F.col(c).isNull()
        groups = base.groupingSets([[F.col(number[c]) for c in combo] for combo in part], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid"), missing.alias("missing"))
        full = ~F.col("missing")
        sums = groups.groupBy("gid").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.when(full, F.col("cnt")).otherwise(0)).alias("full_rows"), F.count_if(full).alias("full_groups"))
        label = F.create_map(*[x for g, c in names.items() for x in (F.lit(g).cast("long"), F.array(*map(F.lit, c)))])
        rows = sums.select(label[F.col("gid")].alias("key_cols"), "n", "n_groups", "full_rows", "full_groups")
        out = rows if out is None else out.unionByName(rows)
    strict = (F.col("n") > 0) & (F.col("full_rows") == F.col("n")) & (F.col("n_groups") == F.col("n"))
    return out.withColumns({"is_strict": strict, "is_lenient": (F.col("full_rows") > 0) & (F.col("full_groups") == F.col("full_rows"))})


def candidate_keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 2, lenient: bool = False) -> list[tuple[str, ...]]:
    """Minimal keys of up to ``most`` columns, in the order of size, then of columns: what pairs of rows don't refute, tested exactly (see ``cover``)."""
    columns = list(columns or df.columns)
    return [tuple(columns[i] for i in c) for c in unique_sets(cover(df, columns), most, lenient)] if columns else []


def single_keys(profiles: DataFrame) -> DataFrame:
    """(tbl, key_cols, size, pos) of the columns that are keys by themselves, from profiles (tbl, col, pos, is_unique)."""
    place = F.row_number().over(Window.partitionBy("tbl").orderBy("pos")) - 1  # a row for each column
    return profiles.filter("is_unique").select("tbl", F.array("col").alias("key_cols"), F.lit(1).alias("size"), place.alias("pos"))


def as_frame(df: DataFrame, table: str, keys: list[tuple[str, ...]]) -> DataFrame:
    """keys as (tbl, key_cols, size, pos)."""
    return df.sparkSession.createDataFrame([(table, list(k), len(k), i) for i, k in enumerate(keys)], "tbl string, key_cols array<string>, size int, pos int")


def primary_keys(keys: DataFrame) -> DataFrame:
    """(tbl, key_cols): of each table's candidate keys (tbl, key_cols, size, pos) a single column named like a key, else the first single one, else the first."""
    named = (F.col("size") == 1) & F.get("key_cols", F.lit(0)).rlike(KEY_NAME)
    best = Window.partitionBy("tbl").orderBy("size", named.desc(), "pos")
    return keys.withColumn("r", F.row_number().over(best)).filter("r = 1").select("tbl", "key_cols")


def primary_key(keys: list[tuple[str, ...]]) -> list[str]:
    """The same choice for one table's keys."""
    import re

    singles = [k for k in keys if len(k) == 1]
    named = [k for k in singles if re.search(KEY_NAME, k[0])]
    return list(next(iter(named or singles or keys), ()))
