"""Greedy one-to-one assignment under a total order of the pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.common import checkpointed

#: Pairs at the head of the order that one task may go through one by one.
HEAD = 50_000


def greedy(pairs: DataFrame, left: str, right: str, order: Sequence[str], head: int = HEAD) -> DataFrame:
    """The pairs that are taken when they are gone through by ``order``, all descending, and each side is used once.

    ``order`` must tell all pairs apart; pairs with a null side are left out. A round first takes every pair that is the best
    of both its sides, which the one-by-one rule takes too; the best of a side is a partial aggregate, so a side with many
    pairs gathers in no task. Where that no longer removes a quarter of the pairs, as in chains, the first ``head`` pairs of
    the order are gone through one by one in a task, sides and order only; no more than that ever is. Pairs of used sides go.
    """
    open_, taken = checkpointed(pairs.filter(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull())), None
    row, rank = F.struct(*[F.col(f"`{c}`") for c in pairs.columns]), F.struct(*order)
    n = open_.count()
    while n:
        if n > head:
            of_left, of_right = (open_.groupBy(F.col(c).alias("side")).agg(F.max_by(row, rank).alias("row")).select("row.*") for c in (left, right))
            now = checkpointed(of_left.intersect(of_right))
            taken, open_ = _taken(taken, now), _without(open_, now, left, right)
            before, n = n, open_.count()
            if n <= before * 3 // 4:
                continue
        now = checkpointed(_walked(open_, left, right, order, head))
        taken, open_ = _taken(taken, now), _without(open_, now, left, right)
        n = open_.count()
    return pairs.limit(0) if taken is None else taken


def _taken(before: DataFrame | None, now: DataFrame) -> DataFrame:
    return now if before is None else before.unionByName(now)


def _without(open_: DataFrame, now: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose sides are both free."""
    return checkpointed(open_.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti").select(*open_.columns))


def _walked(open_: DataFrame, left: str, right: str, order: Sequence[str], head: int) -> DataFrame:
    """Of the first ``head`` pairs by the order those that are taken one by one."""
    places = open_.columns.index(left), open_.columns.index(right)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: tuple[set, set] = set(), set()
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(k).to_pylist() for k in places), strict=True):
                free = x not in used[0] and y not in used[1]
                if free:
                    used[0].add(x)
                    used[1].add(y)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    first = open_.orderBy(*[F.desc(c) for c in order]).limit(head)
    return first.coalesce(1).sortWithinPartitions(*[F.desc(c) for c in order]).mapInArrow(walk, open_.schema)


def greedy_small(pairs: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """The same as one fold, for metadata of some thousand pairs: (left, right) of the pairs taken."""
    walk = F.reverse(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r")))))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    zero = F.array().cast(f"array<struct<l:{kinds[left]},r:{kinds[right]}>>")
    taken = F.aggregate(walk, zero, lambda acc, x: F.when(F.exists(acc, lambda t: (t["l"] == x["l"]) | (t["r"] == x["r"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["l"].alias("l"), x["r"].alias("r"))))))
    return pairs.agg(taken.alias("taken")).select(F.explode("taken").alias("t")).select(F.col("t.l").alias(left), F.col("t.r").alias(right))
