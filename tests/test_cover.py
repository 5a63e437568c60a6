"""Keys and dependencies from agree sets, against trying all combinations; columns of any name through the core operators."""

import random
from itertools import combinations

import pytest

from schemaloom.operators import cover as C
from schemaloom.operators import fds, keys


def minimal_keys(rows, width, most, lenient):
    out = []
    for size in range(1, most + 1):
        for c in combinations(range(width), size):
            if any(set(k) <= set(c) for k in out):
                continue
            cells = [tuple(r[i] for i in c) for r in rows]
            full = [x for x in cells if None not in x]
            if full and len(set(full)) == len(full) and (lenient or len(full) == len(rows)):
                out.append(c)
    return out


def table(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if i % 2 else 'string'}" for i, n in enumerate(names)))


def drawn(rng, n, width, nulls, values):
    cell = lambda i: None if rng.random() < nulls else rng.randrange(values)
    out = [[cell(i) for i in range(width)] for _ in range(n)]
    return [tuple(x if i % 2 or x is None else f"v{x}" for i, x in enumerate(r)) for r in out]


@pytest.mark.parametrize(("seed", "nulls", "values"), [(1, 0, 6), (3, 0.3, 4)])
def test_keys_against_all_combinations(spark, seed, nulls, values):
    rng = random.Random(seed)
    rows = drawn(rng, 120, 7, nulls, values)
    names = ["gid", "cnt", "missing", "_v_b", "b", "row", "lo"]
    df = table(spark, rows, names)
    for lenient in (False, True):
        found = keys.candidate_keys(df, most=4, lenient=lenient)
        assert found == [tuple(names[i] for i in c) for c in minimal_keys(rows, 7, 4, lenient)]


def test_forty_columns_to_size_four(spark):
    rng = random.Random(4)
    rows = [tuple(x if i % 2 else f"v{x}" for i, x in enumerate((k % 20, k // 20 % 20, k // 400, *(rng.randrange(3) for _ in range(37))))) for k in range(1600)]
    names = [f"c{i}" for i in range(40)]
    df = table(spark, rows, names)
    found = keys.candidate_keys(df, most=4)
    assert ("c0", "c1", "c2") in found and found == [tuple(names[i] for i in c) for c in minimal_keys(rows, 40, 4, False)]
    held = C.cover(df, names)
    C.unique_sets(held, 4)
    assert held.passes < 30  # there are 102,090 combinations


@pytest.mark.parametrize("seed", [5])
def test_dependencies_against_all_left_sides(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        a, b = rng.randrange(6), rng.randrange(5)
        rows.append((f"v{a}", b, f"v{a % 3}", (a * b) % 4, None if b == 0 else f"v{b}", rng.randrange(2), None))
    rows += [(None, 1, "v0", None, "v1", 0, None)] * 3
    names = ["gid", "_v_b", "b", "cnt", "missing", "row_count", "lhs"]
    df = table(spark, rows, names)
    want = set()
    for size in (1, 2, 3):
        for c in combinations(range(7), size):
            full = [r for r in rows if None not in [r[i] for i in c]]
            groups = {}
            for r in full:
                groups.setdefault(tuple(r[i] for i in c), []).append(r)
            if not groups or len(groups) > 0.9 * len(full) or len(full) < 0.9 * len(rows):
                continue
            for t in range(7):
                if t not in c and all(len({r[t] for r in g}) == 1 for g in groups.values()):
                    want.add((tuple(names[i] for i in c), names[t], round(len(full) / len(rows), 9), len(rows)))
    got = {(tuple(r.lhs), r.rhs, round(r.support_ratio, 9), r.row_count) for r in fds.discover(df).collect()}
    assert got == want
    strong = {(tuple(r.lhs), r.rhs): r.strength for r in fds.strengths(df, [["gid"], ["b", "_v_b"]], ["_v_b", "missing"]).collect()}
    assert set(strong) == {(("gid",), "_v_b"), (("gid",), "missing"), (("b", "_v_b"), "missing")} and strong[("b", "_v_b"), "missing"] == 1.0


def test_thirty_columns_in_few_passes(spark):
    rng = random.Random(7)
    rows = []
    for k in range(900):
        base = [rng.randrange(12) for _ in range(6)]
        rows.append(tuple(x if i % 2 else f"v{x}" for i, x in enumerate([*base, *(base[i % 6] % (2 + i % 4) for i in range(18)), *(rng.randrange(3) for _ in range(6))])))
    names = [f"c{i}" for i in range(30)]
    held = C.cover(table(spark, rows, names), names)
    found = C.determining(held, range(6, 12), range(30), 2)
    for t in range(6, 12):
        assert (t % 6,) in found[t] or any(len(c) == 1 for c in found[t])
        for c in found[t]:
            seen = {}
            assert all(seen.setdefault(tuple(r[i] for i in c), r[t]) == r[t] for r in rows)
    assert held.passes < 60


def test_nothing_and_one_row(spark):
    assert keys.candidate_keys(table(spark, [], ["a", "b"])) == [] and fds.discover(table(spark, [], ["a", "b"])).count() == 0
    assert keys.candidate_keys(table(spark, [("x", None)], ["a", "b"]), lenient=True) == [("a",)]


def test_groups_are_hashed_in_more_than_one_task(spark):
    df = spark.range(300_000).coalesce(1).selectExpr("id AS c0", "id % 5 AS c1", "CAST(id % 10 AS string) AS c2", "CASE WHEN id % 5 > 0 THEN id % 5 END AS c3")
    held = C.cover(df, df.columns)
    assert held.codes.rdd.getNumPartitions() > 1
    plan = C._grouped(held, [(0,), (1,)], [1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert C.determining(held, range(4), range(4), 1) == {0: [], 1: [(0,), (2,), (3,)], 2: [(0,)], 3: [(0,), (1,), (2,)]}
