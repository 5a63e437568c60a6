"""What pairs of rows refute: agree sets, from which keys and functional dependencies are searched without trying all.

A pair of rows that agree on some columns shows that these are no key, and that they do not determine a column on which the
pair differs. Such agree sets are gathered from a bounded sample of pairs in one pass. The driver, which walks over column
names only, lists the least combinations that no agree set refutes; these are tested exactly on all rows, a batch of them in
each pass, and each that fails brings pairs of rows that refute it and more like it. That goes on until all that is listed
holds. The table is written once, as hashes of 128 bits for each cell, numbered by column, so names of columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.common import checkpointed, scalar

#: Cells whose classes are looked at for the first agree sets (a bound on the sample; no result hangs on it), parts of a large class that give a pair each.
CELLS, PARTS = 100_000, 16
#: Cells of a task in a pass over a table.
TASK = 500_000
#: Combinations that are tested in one pass over the table.
BATCH = 64

Mask = int


def bits(places: Iterable[int]) -> Mask:
    return sum(1 << i for i in places)


@dataclass
class Cover:
    """The codes of a table's columns and the agree sets found so far: (columns equal and not null, columns equal where null is a value)."""

    codes: DataFrame
    width: int
    rows: int
    nulls: list[int]
    agree: set[tuple[Mask, Mask]] = field(default_factory=set)
    passes: int = 1

    def add(self, pairs: Iterable[tuple[str, str]]) -> None:
        """Agree sets as texts of 0 and 1, a sign for each column."""
        self.agree |= {(bits(i for i, x in enumerate(a) if x == "1"), bits(i for i, x in enumerate(b) if x == "1")) for a, b in pairs}

    def refuting(self, target: int | None = None) -> np.ndarray:
        """The maximal sets that are no key (target: that don't determine this column), as rows of 64-bit words."""
        found = sorted({a for a, b in self.agree if target is None or not b >> target & 1}, key=lambda m: -m.bit_count())
        top: list[Mask] = []
        for m in found:
            if not any(m & t == m for t in top):
                top.append(m)
        return self._words(top)

    def _words(self, masks: Sequence[Mask]) -> np.ndarray:
        n = -(-self.width // 64)
        return np.array([[m >> (64 * k) & ((1 << 64) - 1) for k in range(n)] for m in masks], np.uint64).reshape(-1, n)

    def refuted(self, places: tuple[int, ...], sets: np.ndarray) -> bool:
        mine = self._words([bits(places)])
        return bool(((sets & mine) == mine).all(axis=1).any())


def _texts(x: Column, y: Column) -> Column:
    """The two agree sets of two rows (structs of the arrays a, b and n)."""
    each = F.arrays_zip(x["a"].alias("xa"), x["b"].alias("xb"), x["n"].alias("xn"), y["a"].alias("ya"), y["b"].alias("yb"), y["n"].alias("yn"))
    same = lambda z: (z["xa"] == z["ya"]) & (z["xb"] == z["yb"]) & (z["xn"] == z["yn"])
    sign = lambda test: F.when(test, "1").otherwise("0")
    return F.struct(F.array_join(F.transform(each, lambda z: sign(same(z) & ~z["xn"])), "").alias("held"), F.array_join(F.transform(each, lambda z: sign(same(z))), "").alias("equal"))


def cover(df: DataFrame, columns: Sequence[str]) -> Cover:
    """The codes of the columns, written once, and the agree sets of a sample of pairs."""
    base = scalar(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]))
    names = base.columns
    codes = base.select(F.array(*[F.xxhash64(c) for c in names]).alias("a"), F.array(*[F.xxhash64(F.lit(1), c) for c in names]).alias("b"), F.array(*[F.col(c).isNull() for c in names]).alias("n"))
    codes = codes.select(F.monotonically_increasing_id().alias("row"), "*")
    if (tasks := -(-base.count() * len(names) // TASK)) > 1:  # a file of one row group would be one task in every pass
        codes = codes.repartition(tasks, "row")
    codes = checkpointed(codes)
    facts = codes.agg(F.count(F.lit(1)), *[F.count_if(F.get("n", F.lit(i))) for i in range(len(names))]).first()
    out = Cover(codes, len(names), facts[0], list(facts[1:]))
    share = max(1, facts[0] * len(names) // CELLS)
    if facts[0] > 1:
        row = F.struct("a", "b", "n")
        drawn = F.pmod(F.xxhash64("row"), F.lit(share)) == 0
        of_value = lambda i: F.when(F.pmod(F.get("b", F.lit(i)), F.lit(share)) == 0, -1)
        of_row = F.when(drawn, F.pmod(F.xxhash64("row"), F.lit(PARTS * share)) / share).cast("int")
        cell = lambda i, part: F.struct(F.lit(i).alias("col"), F.get("a", F.lit(i)).alias("value"), part.alias("part"))
        drawn_cells = F.filter(F.array(*[cell(i, part) for i in range(len(names)) for part in (of_value(i), of_row)]), lambda c: c["part"].isNotNull())
        each = codes.select("row", row.alias("codes"), F.explode(drawn_cells).alias("c"))
        pairs = each.groupBy("c.col", "c.value", "c.part").agg(F.min_by("codes", "row").alias("x"), F.max_by("codes", "row").alias("y"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        out.add(tuple(r.s) for r in pairs.select(_texts(F.col("x"), F.col("y")).alias("s")).distinct().collect())  # at most a row for each class looked at
        out.passes += 1
    return out


def _grouped(held: Cover, part: Sequence[tuple[int, ...]], more: Sequence[int] = ()) -> DataFrame:
    """(id, h, g, cnt, lo, hi, s0, lo0, hi0, s1, ...): the groups of each combination's rows without nulls in it; s: whether a group has one value of each column of ``more``, else lo and hi are rows that differ in it.

    All is aggregated in numbers of fixed size, as Spark sorts the rows of other aggregates instead of hashing their keys.
    """
    def key(i: int, places: tuple[int, ...]) -> Column:
        full = F.lit(True)
        for p in places:
            full = full & ~F.get("n", F.lit(p))
        return F.when(full, F.struct(F.lit(i).alias("id"), F.xxhash64(*[F.get("a", F.lit(p)) for p in places]).alias("h"), F.xxhash64(*[F.get("b", F.lit(p)) for p in places], F.lit(len(places))).alias("g")))

    values = [F.get(x, F.lit(c)).alias(f"{x}{k}") for k, c in enumerate(more) for x in ("a", "b")]
    each = held.codes.select("row", *values, F.explode(F.array_compact(F.array(*[key(i, p) for i, p in enumerate(part)]))).alias("k"))
    facts = [f(*c).alias(f"{n}{x}{k}") for k in range(len(more)) for x in ("a", "b") for n, f, c in (("min_", F.min, (f"{x}{k}",)), ("max_", F.max, (f"{x}{k}",)), ("lo_", F.min_by, ("row", f"{x}{k}")), ("hi_", F.max_by, ("row", f"{x}{k}")))]
    groups = each.groupBy("k.id", "k.h", "k.g").agg(F.count(F.lit(1)).alias("cnt"), F.min("row").alias("lo"), F.max("row").alias("hi"), *facts)
    same = lambda x, k: F.col(f"min_{x}{k}") == F.col(f"max_{x}{k}")
    one = [(same("a", k) & same("b", k)).alias(f"s{k}") for k in range(len(more))]
    ends = [F.when(same("a", k), F.col(f"{n}_b{k}")).otherwise(F.col(f"{n}_a{k}")).alias(f"{n}{k}") for k in range(len(more)) for n in ("lo", "hi")]
    return groups.select("id", "h", "g", "cnt", "lo", "hi", *one, *ends)


def _chance() -> Column:
    """An order of a combination's groups by chance, without ties: no two groups have the same first row, and XXH64 of a long is one to one."""
    return F.xxhash64("lo")


def _refute(held: Cover, pairs: set[tuple[int, int]]) -> None:
    """Add the agree sets of some pairs of rows: two for each combination that failed, so they are few."""
    if pairs:
        ends = held.codes.sparkSession.createDataFrame(sorted(pairs), "lo long, hi long")
        rows = held.codes.select("row", F.struct("a", "b", "n").alias("codes")).join(F.broadcast(ends.select(F.explode(F.array("lo", "hi")).alias("row")).distinct()), "row")
        rows = checkpointed(rows)
        both = ends.join(rows.select(F.col("row").alias("lo"), F.col("codes").alias("x")), "lo").join(rows.select(F.col("row").alias("hi"), F.col("codes").alias("y")), "hi")
        held.add(tuple(r.s) for r in both.select(_texts(F.col("x"), F.col("y")).alias("s")).distinct().collect())
        held.passes += 1


def _batches(items: Sequence, size: int = BATCH) -> Iterator[Sequence]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def least(held: Cover, sets: np.ndarray, among: Sequence[int], most: int, void: Callable[[tuple[int, ...]], bool] = lambda _: False) -> list[tuple[int, ...]]:
    """The least combinations of up to ``most`` of the columns that no set refutes, in the order of size, then of columns."""
    out: list[tuple[int, ...]] = []
    masks: list[Mask] = []
    for size in range(1, most + 1):
        for c in combinations(among, size):
            m = bits(c)
            if not any(m & k == k for k in masks) and not void(c) and not held.refuted(c, sets):
                out.append(c)
        masks = [bits(c) for c in out]
    return out


def unique_sets(held: Cover, most: int, lenient: bool = False, among: Sequence[int] | None = None) -> list[tuple[int, ...]]:
    """The least sets of up to ``most`` of the columns that no two rows share: strict ones without a null in any row, or lenient ones, whose rows with nulls don't count but some row must have none."""
    among = [i for i in (range(held.width) if among is None else among) if lenient or held.nulls[i] == 0]
    known, void = set(), set()
    empty = lambda c: any(set(v) <= set(c) for v in void)
    while True:
        listed = least(held, held.refuting(), among, most, empty) if held.rows else []
        new = [c for c in listed if c not in known]
        if not new:
            return listed
        refuting: set[tuple[int, int]] = set()
        for part in _batches(new):
            groups = _grouped(held, part)
            shared = F.when(F.col("cnt") > 1, _chance())
            facts = {r.id: r for r in groups.groupBy("id").agg(*[f(c, shared).alias(f"{c}_{n}") for n, f in (("x", F.min_by), ("y", F.max_by)) for c in ("lo", "hi")]).collect()}
            held.passes += 1
            for i, c in enumerate(part):
                if i not in facts:
                    void.add(c)
                elif facts[i].lo_x is None:
                    known.add(c)
                else:
                    refuting |= {(facts[i].lo_x, facts[i].hi_x), (facts[i].lo_y, facts[i].hi_y)}
        _refute(held, refuting)


def determining(held: Cover, targets: Sequence[int], among: Sequence[int], most: int) -> dict[int, list[tuple[int, ...]]]:
    """For each target the least sets of up to ``most`` other columns that determine it, on the rows without nulls in them; null is a value of the target. A set without such rows determines everything."""
    known: set[tuple[tuple[int, ...], int]] = set()
    while True:
        listed = {t: least(held, held.refuting(t), [c for c in among if c != t], most) for t in targets}
        wanted: dict[tuple[int, ...], list[int]] = {}
        for t, lefts in listed.items():
            for c in lefts:
                if (c, t) not in known:
                    wanted.setdefault(c, []).append(t)
        if not wanted:
            return listed
        refuting: set[tuple[int, int]] = set()
        for part in _batches(sorted(wanted, key=lambda c: (len(c), c)), BATCH // 4):
            more = sorted({t for c in part for t in wanted[c]})
            worst = [F.min_by(f"{n}{k}", F.when(~F.col(f"s{k}"), _chance())).alias(f"{n}{k}") for k in range(len(more)) for n in ("lo", "hi")]
            facts = {r.id: r for r in _grouped(held, part, more).groupBy("id").agg(*worst).collect()}
            held.passes += 1
            for i, c in enumerate(part):
                for t in wanted[c]:
                    k = more.index(t)
                    if i not in facts or facts[i][f"lo{k}"] is None:
                        known.add((c, t))
                    else:
                        refuting.add((facts[i][f"lo{k}"], facts[i][f"hi{k}"]))
        _refute(held, refuting)


def group_counts(held: Cover, sets: Sequence[tuple[int, ...]], more: Sequence[int] = ()) -> dict[tuple[int, ...], tuple[int, ...]]:
    """(groups, rows, groups with one value of each column of ``more``, null being a value) without nulls of each set of columns, exact, many of them in a pass."""
    out = {c: (0,) * (2 + len(more)) for c in sets}
    for part in _batches(sets, BATCH // 4 if more else BATCH):
        for r in _grouped(held, part, more).groupBy("id").agg(F.count(F.lit(1)), F.sum("cnt"), *[F.count_if(f"s{k}").alias(f"n{k}") for k in range(len(more))]).collect():
            out[part[r.id]] = tuple(r)[1:]
        held.passes += 1
    return out
