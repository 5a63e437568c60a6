"""Profiles, keys, dependencies and decomposition on hand-made tables: nulls, empties, constants, thresholds, and the two flat-table traces."""

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaloom.operators import cover, decompose, fds, inds, keys, sampling
from schemaloom.operators import profile as P
from schemaloom.operators.common import checkpointed
from schemaloom.operators.model import nested, of_rows
from schemaloom.operators.scores import erd_scores
from schemaloom.operators.validate import entity_profile, validate


def frame(spark, columns, rows):
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def kinds(df):
    return {r["col"]: r["type"] for r in P.profile(df).collect()}


@pytest.mark.parametrize("values, kind", [(["1e3", " 12 ", "+4"], "integer"), (["1.5", "2"], "float"), (["12D", "3F"], "string"), (["1,000"], "string"), (["yes", "no", "yes"], "boolean"), (["0", "1"], "integer"), (["true", "0", "no"], "string"), (["15:32", "09:10"], "datetime"), (["20250703"], "integer"), (["2025-07-03T10:00Z"], "datetime"), (["2025-07-03"] * 19 + ["soon-1"], "datetime"), (["2025-07-03"] * 18 + ["soon-1"] * 2, "string"), ([None, None], "string"), (["belt A-1", "belt B-2"], "string")])
def test_types(spark, values, kind):
    assert kinds(frame(spark, ["x"], [[v] for v in values]))["x"] == kind


def test_profile_of_empty_constant_and_null(spark):
    assert [tuple(r) for r in P.profile(frame(spark, ["a", "b"], [])).orderBy("pos").collect()] == [("a", 0, "string", 0, 0, 0.0, 0, False), ("b", 1, "string", 0, 0, 0.0, 0, False)]
    rows = {r["col"]: r for r in P.profile(frame(spark, ["k", "c", "n"], [[1, "x", None], [2, "x", None]])).collect()}
    assert rows["k"]["is_unique"] and not rows["c"]["is_unique"] and rows["c"]["distinct_cnt"] == 1
    assert (rows["n"]["nulls"], rows["n"]["null_ratio"], rows["n"]["distinct_cnt"], rows["n"]["is_unique"]) == (2, 1.0, 0, False)


def test_arrays_and_maps_are_profiled_as_text(spark):
    df = spark.sql("SELECT array(1, 2) AS a, map('k', 1) AS m UNION ALL SELECT array(1, 2), map('k', 2)")
    assert {r["col"]: r["distinct_cnt"] for r in P.profile(df).collect()} == {"a": 1, "m": 2}


def test_one_null_in_a_key(spark):
    df = frame(spark, ["k", "v"], [[1, "a"], [2, "a"], [None, "b"]])
    assert keys.candidate_keys(df) == [("k", "v")] or keys.candidate_keys(df) == []
    assert keys.candidate_keys(df, lenient=True)[0] == ("k",)
    assert keys.candidate_keys(frame(spark, ["k"], [])) == []


small = st.lists(st.tuples(*[st.one_of(st.none(), st.integers(0, 3))] * 4), min_size=0, max_size=14)


@settings(max_examples=12, deadline=None)
@given(rows=small)
def test_keys_and_dependencies_match_brute_force(spark, rows):
    columns = ["a", "b", "c", "d"]
    df = frame(spark, columns, rows)

    def strict(combo):
        cut = [tuple(r[columns.index(c)] for c in combo) for r in rows]
        return bool(cut) and all(None not in x for x in cut) and len(set(cut)) == len(cut)

    minimal = []
    for size in (1, 2):
        minimal += [c for c in combinations(columns, size) if strict(c) and not any(set(m) < set(c) for m in minimal)]
    assert keys.candidate_keys(df) == minimal
    found = {(tuple(r["lhs"]), r["rhs"]): (r["strength"], r["support_ratio"]) for r in fds.strengths(df, [("a",), ("a", "b")], ["c", "d"]).collect()}
    if not rows:
        assert found == {}
        return
    for lhs, rhs in [(x, y) for x in (("a",), ("a", "b")) for y in ("c", "d")]:
        groups = {}
        for r in rows:
            key = tuple(r[columns.index(c)] for c in lhs)
            if None not in key:
                groups.setdefault(key, []).append(r[columns.index(rhs)])
        ok = sum(len(set(v)) == 1 for v in groups.values())
        assert found[lhs, rhs] == (ok / len(groups) if groups else 0.0, sum(map(len, groups.values())) / len(rows))


def test_discovery_limits(spark):
    rows = [[i % 3, i % 3 * 2, i] for i in range(12)]
    held = lambda n: {(tuple(r["lhs"]), r["rhs"]) for r in fds.discover(frame(spark, ["x", "y", "z"], rows[:n]), left=1).collect()}
    assert held(12) == {(("x",), "y"), (("y",), "x")} and held(11) == set()
    gaps = lambda k: frame(spark, ["x", "y"], [[None if i < k else i % 4, i % 4] for i in range(20)])
    assert (("x",), "y") in {(tuple(r["lhs"]), r["rhs"]) for r in fds.discover(gaps(2), left=1).collect()}
    assert (("x",), "y") not in {(tuple(r["lhs"]), r["rhs"]) for r in fds.discover(gaps(3), left=1).collect()}


def test_better_parent_and_reciprocal_edges(spark):
    tables = {"Team": frame(spark, ["team_id", "name"], [[1, "a"], [2, "b"], [3, "c"]]), "Club": frame(spark, ["team_id", "city"], [[1, "x"], [2, "y"], [3, "z"]]), "Player": frame(spark, ["player_id", "team_id"], [[i, i % 3 + 1] for i in range(9)])}
    erd, _, _ = decompose.baseline(list(tables.items()))
    edges = {(r["from_entity"], r["to_entity"], r["fk_attribute"]) for r in erd.relationships.collect()}
    assert ("Player", "Team", "team_id") in edges and len([e for e in edges if e[0] != "Player"]) == 1


def test_names_agree(spark):
    cases = [("airport_code", "Airport", "code", True), ("paid", "Bill", "id", False), ("home_airport", "Airports", "code", True), ("x_iata", "Airport", "iata", True), ("x_id", "Airport", "id", False), ("Customer_ID", "Person", "customerid", True)]
    df = spark.createDataFrame(cases, "c string, t string, k string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", inds.names_agree(F.col("c"), F.col("t"), F.col("k"))).collect())


def loans(spark):
    """A flat table of library loans: no key but the slip, entities by column names, dates that nothing determines."""
    shops, sites, states, clerks = ["AA", "BB", "CC", "DD", "EE"], ["P1", "P2", "P3", "P4", "P5"], ["S1", "S2", "S3", "S4", "S5", "S6"], ["C1", "C2", "C3", "C4", "C5", "C6"]
    columns = ["slip_number", "reader_card", "title", "copy_label", "due_date", "publisher_code", "publisher_town", "branch_key", "branch_street", "branch_town", "clerk_id", "clerk_desk", "binding_no", "binding"]
    rows = []
    for i in range(19):
        a, p, s, c = i % 5, (i * 2) % 5, i % 6, (i * 5 + 1) % 6
        rows.append([f"{i + 1}L", f"X{i % 12}", f"T{i % 11}", f"B{i % 7}", f"2025-07-{i % 8 + 1:02d}", shops[a], f"Town {a}", sites[p], f"Street {p}", f"Town {p % 4}", clerks[c], f"desk {c % 3}", states[s], f"Cloth {s}"])
    return frame(spark, columns, rows)


def test_first_flat_table(spark):
    parts, chosen, _ = decompose.split([("a/loans.csv", loans(spark))])
    assert {n: list(df.columns) for n, df in parts.items()} == {
        "Loans": ["slip_number", "reader_card", "title", "copy_label", "due_date", "publisher_code", "branch_key", "clerk_id", "binding_no"],
        "Publisher": ["publisher_code", "publisher_town"], "Branch": ["branch_key", "branch_street", "branch_town"], "Clerk": ["clerk_id", "clerk_desk"], "Binding": ["binding_no", "binding"],
    }
    erd, profiles, notes = decompose.baseline([("loans.csv", loans(spark))])
    assert {(r["from_entity"], r["to_entity"], r["from_cardinality"], r["to_cardinality"]) for r in erd.relationships.collect()} == {("Loans", x, "0..N", "1") for x in ("Publisher", "Branch", "Clerk", "Binding")}
    assert {r["entity"]: list(r["primary_key"]) for r in erd.entities.collect()}["Loans"] == ["slip_number"] and len(notes) == 4
    assert {r["col"]: r["type"] for r in profiles.filter("tbl = 'Loans'").collect()}["due_date"] == "datetime"
    assert len(nested(erd).first()["entities"]) == 5
    row = erd_scores(erd, erd).first()
    assert row["entity_f1"] == 1.0 and row["relationship_f1"] == 1.0


def test_second_flat_table(spark):
    """Keys without key-like names: the leftmost is elected; patients are found by dependency."""
    rows = [[f"V{i}", i % 6, f"Name {i % 6}", f"m{i % 6}@x", f"{i}A"] for i in range(14)]
    parts, chosen, _ = decompose.split([("b.csv", frame(spark, ["visit", "patient_id", "called", "mail", "room"], rows))])
    assert {n: list(df.columns) for n, df in parts.items()} == {"B": ["visit", "patient_id", "room"], "Patient": ["patient_id", "called", "mail"]}
    assert chosen == {"Patient": ["patient_id"]}


def test_determinant_that_repeats_just_enough(spark):
    rows = lambda d: [[i, i % d, i % d * 3] for i in range(20)]
    split = lambda d: list(decompose.split([("t", frame(spark, ["id", "part_code", "part_size"], rows(d)))])[0])
    assert split(10) == ["T", "Part"] and split(11) == ["T"]


def test_entity_issues(spark):
    df = frame(spark, ["a", "b", "c", "d"], [[i // 4, i % 4, i // 4 * 10, i % 3] for i in range(16)])
    issues = entity_profile(df, ["a", "b", "c", "d"], ["a", "b"])["issues"]
    assert "partial_dependency:a->c" in issues and not any(x.startswith("pk_") for x in issues)
    assert "transitive_dependency:c->a" not in issues and not any(x.startswith("3nf_violation:a->c") for x in issues)  # b and c are a key too
    assert entity_profile(df, ["a"], [])["issues"] == ["missing_primary_key"]
    assert "pk_not_unique" in entity_profile(df, ["a", "c"], ["a"])["issues"]
    assert "pk_missing_columns:zz" in entity_profile(df, ["a"], ["zz"])["issues"]


def test_validation_scores(spark):
    df = frame(spark, ["id", "v"], [[i, i % 2] for i in range(4)])
    erd = of_rows(spark, {"entities": [{"name": "T", "primary_key": ["id"], "attributes": [{"name": "ID ", "data_type": "INT"}, {"name": "w", "data_type": "INT"}]}]})
    row = validate({"t": df}, erd).first()
    assert (row["precision"], row["recall"], row["relationships"]) == (0.5, 0.5, 1.0)
    nothing = validate({"t": df}, of_rows(spark, {})).first()
    assert (nothing["precision"], nothing["recall"], nothing["total"]) == (0.0, 0.0, 0.0)


def test_long_values_count_by_digest(spark):
    from schemaloom.operators import profile

    texts = ["x" * 5000, "x" * 5000, "x" * 4999 + "y", None]
    df = frame(spark, ["t", "n"], [[t, "9" * 300 if i else "1"] for i, t in enumerate(texts)])
    got = {r["col"]: (r["type"], r["distinct_cnt"], r["nulls"]) for r in profile.profile(df).collect()}
    assert got == {"t": ("string", 2, 1), "n": ("integer", 2, 0)}
    both = inds.inclusions({"a": df.select("t"), "b": df.select(F.col("t").alias("u"))})
    assert {(r["child_col"], r["shared"], r["coverage"]) for r in both.collect()} == {("t", 2, 1.0), ("u", 2, 1.0)}


def test_samples(spark):
    df = frame(spark, ["k", "v"], [[f"{i:03d}", i] for i in range(60)])
    got = [r["k"] for r in sampling.head_middle_tail(df, ["k"]).collect()]
    assert len(got) == 20 and set(got) >= {"000", "004", "055", "059"}
    assert sampling.sample(df, 10).count() == 10 and {tuple(r) for r in sampling.sample(df, 10).collect()} == {tuple(r) for r in sampling.sample(df, 10).collect()}
    assert sampling.aligned(df, [" K", "x"]) == (["k"], ["x"])
    assert sorted(r["value"] for r in sampling.values_of(df.limit(0).unionByName(frame(spark, ["k", "v"], [["a", None]])), "K_").collect()) == ["a"]


def test_shapes_read_what_all_formats_read(spark):
    from schemaloom.functions import values as V

    rng = random.Random(2)
    texts = ["2024-02-29", "2023-02-29", "20240101", "200240101", "+200240101", "-200240101", "+12024-01-01", "2024-1-1", "12:30", "12:30:59", "25:00", "2024-01-01T10:00Z", "2024-01-01t10:00z", "2024-01-01T10:00:00+05:30", "2024-01-01 10:00", "13/01/2024", "01/13/2024", "13/13/2024", "1.5", "-5", "5-LOW", "", " ", "٢٠٢٤-01-01", "2024/01/31", "31-12-2024", "12-31-2024", "99-99-9999", None]
    texts += ["".join(rng.choices("0123456789-/: TZ+", k=rng.choice((5, 8, 10, 16, 19, 20)))) for _ in range(1500)]
    texts += [rng.choice(["{:04d}-{:02d}-{:02d}", "{2:02d}/{1:02d}/{0:04d}", "{1:02d}-{2:02d}-{0:04d}", "{:04d}{:02d}{:02d}"]).format(rng.randrange(3000), rng.randrange(14), rng.randrange(33)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for formats in (V.TIMESTAMPS, V.DATES):
        plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in formats]).isNotNull()
        wrong = df.filter(F.coalesce(V.parses(F.col("t"), formats), F.lit(False)) != plain)
        assert [r.t for r in wrong.collect()] == []
        assert df.filter(plain).count() > 300


def test_entity_tests_sort_no_rows(spark, monkeypatch):
    df = spark.range(200_000).coalesce(1).selectExpr("id AS k", "CAST(id % 50 AS string) AS n", "CAST(id % 5 AS string) AS r", "IF(id % 40 = 0, NULL, id % 50) AS s", "CAST(NULL AS string) AS e")
    plans, grouped, covered = [], cover._grouped, []
    monkeypatch.setattr(cover, "_grouped", lambda *a: plans.append(grouped(*a)) or plans[-1])
    monkeypatch.setattr(cover, "checkpointed", lambda x: covered.append(checkpointed(x)) or covered[-1])
    found = entity_profile(df, ["n", "r", "s"], ["k", "n"])
    partial, third = ("k->r", "k->s", "n->r"), ("n->r", "s->n", "s->r", "n+s->r", "r+s->n")
    assert found["issues"] == ["pk_not_minimal:k", *[f"partial_dependency:{x}" for x in partial], *[f"3nf_violation:{x}" for x in third], "transitive_dependency:s->r"] and found["candidate_keys"] == []
    assert covered[0].rdd.getNumPartitions() > 1 and sum("row" in x.columns and "a" in x.columns for x in covered) == 1  # codes are written once
    for out in (*plans, fds.strengths(df, [["k"], ["n"]], ["n", "r", "s", "e"]), fds.determines(df, "n", ["r", "s", "e"])):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.lhs[0], r.rhs): r.strength for r in fds.strengths(df, [["k"], ["n"]], ["n", "r", "s", "e"]).collect()} == {("k", "n"): 1.0, ("k", "r"): 1.0, ("k", "s"): 1.0, ("k", "e"): 1.0, ("n", "r"): 1.0, ("n", "s"): 0.9, ("n", "e"): 1.0}
    assert {r.col: r.holds for r in fds.determines(df, "n", ["r", "s", "e"]).collect()} == {"r": True, "s": False, "e": True}


def test_entity_of_an_empty_table(spark):
    df = spark.range(0).selectExpr("id AS a", "CAST(id AS string) AS b")
    assert entity_profile(df, ["a", "b"], ["a"])["issues"] == ["pk_not_unique", "non_key_not_dependent_on_pk:b"]
