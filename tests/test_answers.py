"""The answer ledger, candidate models and proposed vocabularies, with a provider that counts its calls."""

import json

import pytest

from schemaloom.operators import ontology
from schemaloom.operators.model import of_rows
from schemaloom.plans.answers import AnswerLedger, candidate_models, proposed_vocabulary
from schemaloom.plans.prompts import ontology_prompt
from schemaloom.plans.settings import Settings


class Counting:
    """Answers with what a function makes of the temperature; breaks off at a call."""

    def __init__(self, make, breaks_at=None):
        self.make, self.calls, self.breaks_at, self.prompts = make, 0, breaks_at, []

    def available(self):
        return True

    def answer(self, prompt, temperature):
        self.calls += 1
        if self.calls == self.breaks_at:
            raise KeyboardInterrupt
        self.prompts.append(prompt)
        return self.make(temperature)


def flat(spark):
    return [("loans.csv", spark.createDataFrame([(i, f"member {i % 7}", i % 3, f"b{i % 3}") for i in range(40)], "loan_id int, member string, branch_id int, branch_name string"))]


def model(temperature):
    if temperature == 0.6:
        return '{"entities": [{"primary_key": ["x"], "attributes": []}]}'  # an entity without a name is no model
    return json.dumps({"entities": [{"name": "Loan", "primary_key": ["loan_id"], "attributes": [{"name": "loan_id"}, {"name": "member"}]}, {"name": f"Branch{int(temperature * 10)}", "primary_key": ["branch_id"], "attributes": [{"name": "branch_id"}]}], "relationships": []})


def test_a_broken_run_goes_on_without_a_second_call(spark, tmp_path):
    settings = Settings(temperatures="0.2,0.6,0.9")
    broken = Counting(model, breaks_at=3)
    with pytest.raises(KeyboardInterrupt):
        candidate_models(flat(spark), AnswerLedger(spark, str(tmp_path / "ledger"), broken), settings)
    again = Counting(model)
    found = candidate_models(flat(spark), AnswerLedger(spark, str(tmp_path / "ledger"), again), settings)
    assert again.calls == 1 and [(c.temperature, c.source) for c in found] == [(0.2, "hybrid"), (0.9, "hybrid"), (0.0, "baseline")]
    names = {r.entity for r in found[0].erd.entities.collect()}
    assert "Branch2" in names and {r.attr for r in found[0].erd.attributes.collect()} >= {"branch_name", "member"}
    third = Counting(model)
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"), third)
    assert ledger.answer(again.prompts[0], 0.9) == model(0.9) and third.calls == 0 and ledger.answers().count() == 3
    ledger.answer("other", 0.2), ledger.answer("other", 0.2)
    assert third.calls == 2  # asked twice on purpose: two answers


def test_without_a_provider_only_the_data_speaks(spark):
    assert [c.source for c in candidate_models(flat(spark))] == ["baseline"]


ERD = {"entities": [{"name": "Branch", "primary_key": ["branch_id"], "attributes": [{"name": "branch_id", "is_primary_key": True}, {"name": "town"}]}, {"name": "Loan", "primary_key": ["loan_id"], "attributes": [{"name": "loan_id", "is_primary_key": True}, {"name": "branch_id", "references": "Branch.branch_id"}]}]}


def ontology_answer(_):
    prop = lambda s, n: {"source": s, "maps_to": {"type": "property", "canonical_name": n, "role": "descriptive"}}
    return "So: " + json.dumps({"concepts": [{"canonical_name": "Library Branch", "ontological_category": "category", "source_entity": "Branch", "attributes": [prop("Branch.branch_id", "code"), prop("Branch.town", "place")]}, {"canonical_name": "Loan", "ontological_category": "kind", "source_entity": "Loan", "attributes": [prop("Loan.branch_id", "issuedBy")]}], "relations": []})


def test_vocabularies_of_a_proposal(spark):
    erd = of_rows(spark, ERD)
    rules = ontology.rule_based(erd)
    provider = Counting(ontology_answer)
    raw = proposed_vocabulary(erd, provider, compare=True)
    assert {(r.attribute, r.canonical) for r in raw.vocabulary.mappings.collect()} == {("Branch.branch_id", "code"), ("Branch.town", "place"), ("Loan.branch_id", "issuedBy")}
    assert ("warning", "attribute_missing", "Loan.loan_id") in {tuple(r) for r in raw.issues.collect()}
    framed = proposed_vocabulary(erd, provider, compare=True, scaffold=rules).vocabulary
    assert {(r.attribute, r.canonical) for r in framed.mappings.collect()} == {("Branch.branch_id", "code"), ("Branch.town", "place"), ("Loan.loan_id", "loanId"), ("Loan.branch_id", "issuedBy")}
    assert {(r.source_entity, r.canonical) for r in framed.entities.collect()} == {("Branch", "Library Branch"), ("Loan", "Loan")}
    whole = proposed_vocabulary(erd, provider, existing=raw.vocabulary, previous=raw.vocabulary, refinement="shorter names", history=["first"], unpacking=ontology.unpacking(erd)).vocabulary
    assert {r.attribute for r in whole.mappings.collect()} == {"Branch.branch_id", "Branch.town", "Loan.loan_id", "Loan.branch_id"}
    last = provider.prompts[-1]
    assert all(x in last for x in ("Vocabulary:", "Vocabulary before:", "Hints:", "Refine: shorter names", "Asked before:\nfirst")) and "Reuse terms" in last and "Reuse terms" not in provider.prompts[0]
    assert "Hints:" not in ontology_prompt(erd)
    with pytest.raises(ValueError):
        proposed_vocabulary(erd, Counting(lambda _: "no JSON"))
    assert proposed_vocabulary(erd).issues is None
