"""Greedy assignment, vocabulary building, enrichment, sources, prompts and runs."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.operators import assign, ontology
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.model import of_rows
from schemaloom.plans import naming, prompts, runs
from schemaloom.plans.settings import Settings
from schemaloom.queries.fixtures import ERD_BASE, ERD_PROPOSAL, ERD_TRUTH, GOLD_CONCEPTS, ONTOLOGY_A, ONTOLOGY_B
from schemaloom.queries.models import _ontology
from schemaloom.sources import files


@settings(max_examples=8, deadline=None)
@given(scores=st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(0, 3), min_size=1, max_size=14))
def test_greedy_is_the_one_by_one_rule(spark, scores):
    pairs = spark.createDataFrame([(i, j, s) for (i, j), s in scores.items()], "i int, j int, s int")
    want, left, right = set(), set(), set()
    for s, i, j in sorted(((s, i, j) for (i, j), s in scores.items()), reverse=True):
        if i not in left and j not in right:
            want.add((i, j))
            left.add(i)
            right.add(j)
    for how in (assign.greedy, assign.greedy_small):
        assert {(r["i"], r["j"]) for r in how(pairs, "i", "j", ["s", "i", "j"]).collect()} == want
    assert assign.greedy(pairs.limit(0), "i", "j", ["s", "i", "j"]).count() == 0


def test_vocabulary_reuses_and_makes_terms(spark):
    attributes = of_rows(spark, {"entities": [{"name": "Flight", "attributes": [{"name": "flight_number"}, {"name": "departure"}]}, {"name": "Trip", "attributes": [{"name": "flightNumber"}, {"name": "fare"}]}]}).attributes
    terms = spark.createDataFrame([], "name string, synonyms array<string>, sources array<string>, pos int")
    evidence = spark.createDataFrame([("flightnumber", "flightnumber", 1.0)], "a string, b string, overlap double")
    kinds = spark.createDataFrame([("flightnumber", "text"), ("departure", "date"), ("fare", "numeric")], "part string, kind string")
    out = {r["attribute"]: (r["canonical"], r["is_new"]) for r in voc.build(attributes, terms, evidence, kinds).collect()}
    assert out == {"Flight.flight_number": ("Flight Number", True), "Flight.departure": ("Departure", True), "Trip.flightNumber": ("Flight Number", False), "Trip.fare": ("Fare", True)}


def test_entity_scores(spark):
    entities = spark.createDataFrame([("Customer", ["name", "city"])], "entity string, attrs array<string>")
    canon = spark.createDataFrame([("Customers", ["name"]), ("Plane", [])], "canonical string, attrs array<string>")
    got = {r["canonical"]: r["score"] for r in voc.entity_scores(entities, canon, spark.createDataFrame([("Customer",)], "entity string")).collect()}
    assert got["Customers"] == pytest.approx(0.5 + 0.3 * 0.5 + 0.2) and got["Plane"] < voc.ENTITY


def test_enrichment(spark):
    from schemaloom.operators.profile import value_index

    df = spark.createDataFrame([(f"{i}", "open" if i % 2 else "shut", f"{i}.50", "12 kg") for i in range(20)], "door_id string, door string, price_eur string, load string")
    attrs = of_rows(spark, {"entities": [{"name": "Door", "attributes": [{"name": c, "data_type": "VARCHAR"} for c in df.columns]}]}).attributes
    samples = spark.createDataFrame([("load", ["12 kg"])], "part string, samples array<string>")
    hints = ontology.unpacking(of_rows(spark, {"entities": [{"name": "Door", "attributes": [{"name": c} for c in df.columns]}]}))["attributes"]
    got = {r["attr"]: r for r in voc.enriched(attrs, samples, value_index(df), hints).collect()}
    assert {a: r["logical_type"] for a, r in got.items()} == {"door_id": "identifier", "door": "categorical", "price_eur": "currency", "load": "text"}
    assert got["door"]["domain"] == ["open", "shut"] and got["price_eur"]["currency"] == "EUR" and got["load"]["unit"] == "kg"
    assert got["door_id"]["confidence"] == pytest.approx(0.45 + 0.12 + 0.08 + 0.06 + 0.12)


def test_scaffold_keeps_structure(spark):
    rules = ontology.rule_based(of_rows(spark, ERD_TRUTH))["attributes"]
    named = spark.createDataFrame([("booking.flight_DATE,Booking.flight_number", "onFlight", 0), ("Airport.city", "", 1), ("Airport.city", "town", 2), ("Airport.city", "later", 3), ("No.where", "x", 4)], "source string, canonical string, pos int")
    out = {r["source"]: r["canonical"] for r in ontology.with_scaffold(named, rules).collect()}
    assert out["Booking.flight_number, Booking.flight_date"] == "onFlight" and out["Airport.city"] == "town" and len(out) == rules.count()


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('x,x,1\n1,NA,"a ""b"", c"\n,null,\n')
    df = files.csv(spark, str(p))
    assert df.columns == ["x", "x.1", "1"] and [tuple(r) for r in df.collect()] == [("1", None, 'a "b", c'), (None, None, None)]
    assert [tuple(r) for r in files.csv(spark, str(p), nulls=False).collect()] == [("1", "NA", 'a "b", c'), ("", "null", "")]
    assert files.whole_text(spark, str(p)).first()[0] == p.read_text()
    assert [n for n, _ in files.tables([df, df], ["one"])] == ["one", "Table2"]


def test_model_sources(spark, tmp_path):
    (tmp_path / "erd.json").write_text(json.dumps(ERD_TRUTH, indent=1))
    erd, same = files.erd(spark, str(tmp_path / "erd.json")), of_rows(spark, ERD_TRUTH)
    for a, b in ((erd.entities, same.entities), (erd.attributes, same.attributes)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert erd.relationships.count() == 4
    doc = {"concepts": [{"canonical_name": "C", "source_entity": "E", "attributes": [{"source": "E.a", "maps_to": {"type": "relation_role", "relation": "r", "target_concept": "T", "accepted": ["q"]}}]}]}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=1))
    o = files.ontology(spark, str(tmp_path / "o.json"))
    assert tuple(o["attributes"].first()) == ("C", 0, "E.a", "relation_role", "r", None, "T", ["q"]) and o["relations"].count() == 0
    (tmp_path / "b.json").write_text('["one", "two"]')
    assert files.brief(spark, str(tmp_path / "b.json")).first()[0] == "- one\n- two"


def test_results(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("a", "s", 0, "m", v), ("a", "s", 1, "m", v + 2)], "target string, scenario string, run int, metric string, value double")
    for i, v in enumerate((1.0, 5.0)):
        files.append_results(rows(v), str(tmp_path / "r"), f"run{i}")
    last = files.latest_results(spark, str(tmp_path / "r"), ["target", "scenario", "run", "metric"])
    assert sorted(r["value"] for r in last.collect()) == [5.0, 7.0]
    from schemaloom.operators.scores import over_runs

    summary = over_runs(last)
    assert (summary.first()["mean"], summary.first()["std"], summary.first()["runs"]) == (6.0, 1.0, 2)
    assert files.metric_table(summary).first()["m"] == 6.0
    files.write_json(summary, str(tmp_path / "j"), "run1")
    files.write_report(summary, spark.createDataFrame([("a", "s", "x", "TP")], "target string, scenario string, item string, status string"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first()["n_runs"] == 2


def test_providers_and_runs(spark):
    pauses = []

    class Shaky:
        def __init__(self):
            self.n = 0

        def available(self):
            return True

        def answer(self, prompt, temperature):
            self.n += 1
            if self.n == 1:
                raise RuntimeError("503 unavailable")
            return "ok"

    assert naming.asked(Shaky(), "p", 0.2, sleep=pauses.append) == "ok" and pauses == [1.5]
    assert Settings("0.1,x, 0.5").temperature_list() == [0.1, 0.5] and Settings("").temperature_list() == [0.2, 0.6, 0.9]
    assert naming.inlined({"$defs": {"A": {"type": "string", "title": "A"}}, "properties": {"a": {"$ref": "#/$defs/A"}}}) == {"properties": {"a": {"type": "string"}}}
    df = spark.createDataFrame([(str(i), f"c{i % 4}", f"n{i % 4}") for i in range(16)], "id string, unit_code string, unit_name string")
    answer = "So: " + json.dumps({**ERD_PROPOSAL, "entities": [{**e, "attributes": [{k: v for k, v in a.items() if v is not None} for a in e["attributes"]]} for e in ERD_PROPOSAL["entities"]]})
    out = runs.discover([("things", df)], of_rows(spark, ERD_BASE), "t", naming.Replay({0.2: [answer, "no json"]}), "prompt", Settings("0.2", repeats=2))
    got = {(r["scenario"], r["run"], r["metric"]): r["value"] for r in out.collect()}
    assert got["baseline", 0, "pred_entities"] == 2.0 and got["proposal", 0, "pred_entities"] == 3.0 and ("hybrid", 0, "entity_f1") in got
    gold = _ontology(spark, GOLD_CONCEPTS)
    mapped = {r["metric"]: r["value"] for r in runs.map_ontology(of_rows(spark, ERD_TRUTH), gold, "t").collect()}
    assert mapped["refinement_accuracy"] == pytest.approx(4 / 9)


def test_scenarios_and_provider_integration(spark):
    df = spark.createDataFrame([(str(i), f"c{i % 4}", f"n{i % 4}") for i in range(16)], "id string, unit_code string, unit_name string")
    only = runs.discover([("things", df)], of_rows(spark, ERD_BASE), "t", scenarios=["baseline"])
    assert {r["scenario"] for r in only.collect()} == {"baseline"}
    assert runs.discover([("things", df)], of_rows(spark, ERD_BASE), "t", scenarios=["proposal"]).count() == 0
    with pytest.raises(ValueError):
        runs.discover([("things", df)], of_rows(spark, ERD_BASE), "t", scenarios=["other"])
    a, b = _ontology(spark, ONTOLOGY_A), _ontology(spark, ONTOLOGY_B)
    gold = {"pairs": spark.createDataFrame([("Flight", "Flight", "flights"), ("Passenger", "Passenger", "people")], "canonical string, a string, b string"), "unique": spark.createDataFrame([("b", "Fare")], "side string, name string"), "conflicts": spark.createDataFrame([], "type string, canonical string, detail string")}
    said = json.dumps({"alignments": [{"canonical": "Flight", "erd_a": "Flight", "erd_b": "flights"}, {"canonical": "Traveller", "erd_a": "Passenger", "erd_b": "people"}], "unique_to_a": [], "unique_to_b": ["Fare"], "integrated_concepts": ["Flight", "Traveller", "Fare"]})
    plan, out = runs.integrate_models(a, b, gold, provider=naming.Replay({0.2: [said, "broken", said]}), brief="general advice", settings=Settings("0.2,0.2"))
    got = {(r["scenario"], r["run"], r["metric"]): r["value"] for r in out.collect()}
    assert {s for s, _, _ in got} >= {"rule_based", "proposal", "proposal_brief"} and got["proposal", 0, "f1"] == 1.0 and got["proposal", 0, "unique_b_coverage"] == 1.0
    assert plan["alignments"].count() > 0


def test_prompts_hold_what_they_should(spark):
    df = spark.createDataFrame([(str(i), f"c{i % 4}") for i in range(30)], "id string, code string")
    base = of_rows(spark, ERD_BASE)
    text = prompts.erd_prompt(df, ["id"], base, "two lines", ["earlier"], level=3)
    assert all(x in text for x in ("id,code", "- code (string): 4 different", "two lines", "earlier", "Bookings", "airport_code"))
    assert "id,code" not in prompts.erd_prompt(df, ["id"], level=1)
    rules = ontology.rule_based(of_rows(spark, ERD_TRUTH))
    assert "hasFlight" in prompts.ontology_prompt(of_rows(spark, ERD_TRUTH), scaffold=rules) and "Booking" in prompts.integration_prompt(rules, rules, "brief")


def _plain_greedy(rows):
    left, right, out = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (r[2], r[0], r[1]), reverse=True):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b, s))
    return out


def test_greedy_by_prefixes(spark):
    import random

    from schemaloom.operators.assign import greedy

    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.randrange(50), rng.randrange(9)) for _ in range(900)]
    rows = [(a, b, s) for (a, b), s in {(a, b): s for a, b, s in rows}.items()]
    df = spark.createDataFrame([*rows, (None, 1, 99), (1, None, 99)], "a int, b int, s int")
    for head in (7, 100, 10_000):
        assert {tuple(r) for r in greedy(df, "a", "b", ["s", "a", "b"], head).collect()} == _plain_greedy(rows)


def test_a_long_chain_needs_few_jobs(spark):
    from schemaloom.operators.assign import greedy

    chain = [(i // 2, (i + 1) // 2, 10_000 - i) for i in range(10_000)]
    df = spark.createDataFrame(chain, "a int, b int, s int")
    spark.sparkContext.setJobGroup("chain", "chain")
    assert {tuple(r) for r in greedy(df, "a", "b", ["s", "a", "b"]).collect()} == _plain_greedy(chain)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_results_are_committed_as_a_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from schemaloom.sources import files

    path = str(tmp_path / "results")
    rows = spark.range(4).select("id", F.lit("a").alias("value"))
    files.append_results(rows, path, "run 1/x")
    broken = rows.withColumn("value", F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.lit("b")))
    with pytest.raises(Exception, match="broken"):
        files.append_results(broken, path, "run 2")
    assert {r.value for r in files.all_results(spark, path).collect()} == {"a"}
    files.append_results(rows.withColumn("value", F.lit("c")), path, "run 2")
    with pytest.raises(files.RunExists):
        files.append_results(rows.withColumn("value", F.lit("d")), path, "run 2")
    last = files.latest_results(spark, path, ["id"]).collect()
    assert sorted((r.id, r.value, r.run_id) for r in last) == [(i, "c", "run 2") for i in range(4)]
