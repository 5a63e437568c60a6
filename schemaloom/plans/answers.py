"""Answers of a naming provider: a ledger that keeps them, candidate models, and a vocabulary from a proposal."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import decompose, hybrid, ontology
from schemaloom.operators.model import Erd
from schemaloom.plans.naming import NamingProvider, NoProvider, asked, read_answer
from schemaloom.plans.prompts import erd_prompt, ontology_prompt
from schemaloom.plans.runs import asked_erd, contract
from schemaloom.plans.settings import Settings
from schemaloom.plans.vocabularies import Vocabulary, build_vocabulary, of_ontology
from schemaloom.sources.files import CONCEPTS, RELATIONS, ontology_tables


class AnswerLedger:
    """A provider whose answers are written before they are used, so that a run that broke off asks nothing twice.

    An answer's key is the digest of the prompt, the temperature and how often both were asked before in the run; each lies
    in a folder of its own below ``path``, which Spark's commit makes visible as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, provider: NamingProvider):
        self.spark, self.path, self.provider, self.times = spark, path.rstrip("/"), provider, Counter()

    def available(self) -> bool:
        return self.provider.available()

    def _exists(self, folder: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def answer(self, prompt: str, temperature: float) -> str:
        asked_before = self.times[prompt, temperature]
        key = hashlib.sha256(f"{temperature!r} {asked_before} {prompt}".encode()).hexdigest()
        folder = f"{self.path}/{key}"
        if not self._exists(folder):
            text = self.provider.answer(prompt, temperature)
            row = self.spark.createDataFrame([(key, float(temperature), text)], "key string, temperature double, answer string")
            row.coalesce(1).write.mode("overwrite").parquet(folder)  # what a broken run left without its mark is written anew
        self.times[prompt, temperature] += 1
        return self.spark.read.schema("key string, temperature double, answer string").parquet(folder).first()["answer"]

    def answers(self) -> DataFrame:
        """(key, temperature, answer) of all that is kept."""
        return self.spark.read.schema("key string, temperature double, answer string").parquet(f"{self.path}/*")


@dataclass(frozen=True)
class Candidate:
    """A model and where it comes from: ``hybrid``, a proposal at a temperature merged with the data's facts, or ``baseline``, these alone."""

    temperature: float
    erd: Erd
    source: str


def checked(found: Erd) -> Erd:
    """The model, if its entities and their attributes all have names and there are some; else ValueError."""
    unnamed = found.entities.filter("entity is null or trim(entity) = ''").count() + found.attributes.filter("attr is null or trim(attr) = ''").count()
    if unnamed or found.entities.isEmpty():
        raise ValueError("the proposal is no model: it has no entities, or some without a name")
    return found


def candidate_models(tables: Sequence[tuple[str, DataFrame]], provider: NamingProvider = NoProvider(), settings: Settings = Settings(), refinement: str = "", previous: Erd | None = None, history: Sequence[str] = ()) -> list[Candidate]:
    """The candidate models of tables, those of the provider first, one for each temperature that gave a valid model, and always the data's own.

    The prompt shows each table's rows and statistics, what the data gives, the previous model, earlier prompts and the
    refinement that is asked for. No true model is needed.
    """
    base, _, _ = decompose.baseline(tables)
    own = Candidate(0.0, base, "baseline")
    if not provider.available():
        return [own]
    notes = [*history, *([f"Model so far:\n{ontology.erd_text(previous).first()[0]}"] if previous is not None else []), *([f"Refine: {refinement}"] if refinement else [])]
    prompt = "\n\n".join(erd_prompt(df, df.columns, base if i == 0 else None, history=notes if i == 0 else ()) for i, (_, df) in enumerate(tables))
    out = []
    for temperature in settings.temperature_list():
        try:
            found = checked(asked_erd(tables[0][1].sparkSession, provider, prompt, temperature, settings))
        except (RuntimeError, ValueError, KeyError, IndexError):
            continue
        out.append(Candidate(temperature, hybrid.merge(base, found), "hybrid"))
    return [*out, own]


@dataclass(frozen=True)
class Proposed:
    """A vocabulary and what the proposal that it comes from violates (level, issue, item); no issues where nothing was asked."""

    vocabulary: Vocabulary
    issues: DataFrame | None


def proposed_vocabulary(
    erd: Erd, provider: NamingProvider = NoProvider(), existing: Vocabulary | None = None, data: dict[str, DataFrame] | None = None, *, compare: bool = False, scaffold: dict[str, DataFrame] | None = None,
    unpacking: dict[str, DataFrame] | None = None, hints: bool = True, previous: Vocabulary | None = None, refinement: str = "", history: Sequence[str] = (), brief: str = "", temperature: float = 0.0, settings: Settings = Settings(),
) -> Proposed:
    """The vocabulary of a model from a provider's proposal; without a provider the plain one.

    ``scaffold`` (concepts, attributes as of ``ontology.rule_based``) fixes the structure: only names are taken from the
    proposal. ``compare``: the proposal as it is, with qualified columns, for measuring; else it goes through the whole run of
    ``build_vocabulary``. ``unpacking``: hints that are given instead of the model's own (see ``ontology.unpacking``).
    """
    spark = erd.entities.sparkSession
    if not provider.available():
        return Proposed(build_vocabulary(erd, "plain", existing=existing, data=data, hints=hints), None)
    told = (unpacking if unpacking is not None else ontology.unpacking(erd)) if hints else None
    prompt = ontology_prompt(erd, brief, existing.terms if existing else None, scaffold, told, previous.terms if previous else None, history, refinement, compare)
    doc = read_answer(spark, asked(provider, prompt, temperature, settings), f"concepts {CONCEPTS}, relations {RELATIONS}").select("doc.*")
    if doc.filter("concepts is not null").isEmpty():
        raise ValueError("the proposal is no ontology")
    named = ontology_tables(doc)
    concepts, attributes = named["concepts"], named["attributes"]
    if scaffold is not None:
        attributes = ontology.with_scaffold(attributes.select("source", "canonical", "pos"), scaffold["attributes"])
        concepts = ontology.with_scaffold(concepts.select("source", F.col("concept").alias("canonical"), "pos"), scaffold["concepts"].withColumnRenamed("concept", "canonical")).withColumnRenamed("canonical", "concept")
        renamed = concepts.select("source", "concept").join(scaffold["concepts"].select("source", F.col("concept").alias("old")), "source").select("old", "concept")
        attributes = attributes.withColumnRenamed("concept", "old").join(renamed, "old").drop("old")
    proposal = of_ontology({"concepts": concepts, "attributes": attributes}, compare)
    vocabulary = proposal if compare else build_vocabulary(erd, "proposal", proposal, existing, data, hints)
    return Proposed(vocabulary, contract(doc, erd))
