"""Projection of flat tables into entities, role unions, samples and first values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.names import bare_key, trimmed_key
from schemaloom.operators.common import cells, scalar


def role_union(df: DataFrame, projections: Sequence[dict[str, str]], key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows of an entity that a flat table holds in several roles: each projection maps attributes to columns.

    Of equal keys the first row wins, by the role's place, then by ``order`` (columns of df); without a key, of equal rows.
    The first row is a partial aggregate, so a key that holds most of the rows costs no more than others.
    """
    out = None
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    names = list(projections[0])
    for i, columns in enumerate(projections):
        row = F.struct(*[F.col(f"`{columns[a]}`").alias(a) for a in names])
        part = df.select(row.alias("entity"), F.struct(F.lit(i).alias("role"), place.alias("row")).alias("place"))
        out = part if out is None else out.unionByName(part)
    keys = [F.col("entity").getField(c).alias(f"key{i}") for i, c in enumerate(key or names)]
    return out.groupBy(*keys).agg(F.min_by("entity", "place").alias("entity")).select("entity.*")


def aligned(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """The table's columns that the names mean (trimmed, without case; the first wins), and the names without one."""
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.strip().lower(), c)
    found = [have.get(n.strip().lower()) for n in names]
    return [c for c in found if c], [n for n, c in zip(names, found, strict=True) if not c]


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's cells as texts, the same wherever it is computed: MD5 over the cells, null told apart from empty."""
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")))
    return F.md5(F.concat_ws("|", *[cell(c) for c in df.columns]).cast("binary"))


def sample(df: DataFrame, rows: int = 5000) -> DataFrame:
    """At most ``rows`` rows, the same ones each time: those with the least hashes."""
    return df.orderBy(row_hash(df)).limit(rows)


def head_middle_tail(df: DataFrame, order: Sequence[str], ends: int = 5, middle: int = 10) -> DataFrame:
    """The first and last rows by ``order`` and some of the others, chosen by hash, without repetition; three top-k selections."""
    up = [F.col(c) for c in order]
    head = df.orderBy(*up).limit(ends)
    tail = df.orderBy(*[c.desc() for c in up]).limit(ends)
    rest = df.join(F.broadcast(head.unionByName(tail).select(*order).distinct()), list(order), "left_anti")
    some = rest.select(*df.columns).orderBy(row_hash(df)).limit(middle)
    return head.unionByName(some).unionByName(tail).distinct()


def first_values(df: DataFrame, order: Sequence[str], most: int = 40) -> DataFrame:
    """(col, pos, rank, value): the values of each column in the first rows; no task sees more than that."""
    rows = df.orderBy(*order).limit(most)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    each = [F.struct(F.lit(c).alias("col"), F.lit(i).alias("pos"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(scalar(df).columns)]
    return scalar(ranked).select("rank", F.explode(F.array(*each)).alias("c")).select("c.col", "c.pos", "rank", "c.value")


def values_of(df: DataFrame, attribute: str) -> DataFrame:
    """(value): the non-null values of the columns that are named like the attribute."""
    return cells(df).filter((bare_key("col") == bare_key(F.lit(attribute))) & F.col("value").isNotNull()).select("value")


def entity_values(df: DataFrame) -> DataFrame:
    """(value): the distinct non-blank cells of a table, trimmed and in lower case."""
    return cells(df).select(trimmed_key("value").alias("value")).filter("value <> ''").distinct()
