"""Whole runs over tables and models, repeated and averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import decompose, hybrid, integrate, ontology, scores
from schemaloom.operators.common import checkpointed
from schemaloom.operators.model import ENTITY, RELATION, Erd, flat
from schemaloom.plans.naming import NamingProvider, NoProvider, asked, read_answer
from schemaloom.plans.prompts import integration_prompt
from schemaloom.plans.settings import Settings
from schemaloom.sources.files import CONCEPTS, RELATIONS, ontology_tables


#: Scenarios of each kind of run, and the columns of their results.
DISCOVERY, MAPPING = ("baseline", "proposal", "hybrid"), ("rule_based", "named")
RUN = "target string, scenario string, run int, metric string, value double"
#: An integration that a provider proposes.
INTEGRATION = "alignments array<struct<canonical: string, erd_a: string, erd_b: string>>, unique_to_a array<string>, unique_to_b array<string>, integrated_concepts array<string>"


def _known(scenarios: Sequence[str], every: Sequence[str]) -> set[str]:
    if wrong := set(scenarios) - set(every):
        raise ValueError(f"no such scenario: {', '.join(sorted(wrong))}")
    return set(scenarios)


def long_form(row: DataFrame, target: str, scenario: str, run: int) -> DataFrame:
    """A row of metrics as (target, scenario, run, metric, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]))
    return row.select(F.lit(target).alias("target"), F.lit(scenario).alias("scenario"), F.lit(run).alias("run"), each.alias("m")).select("target", "scenario", "run", "m.metric", "m.value")


def asked_erd(spark: SparkSession, provider: NamingProvider, prompt: str, temperature: float, settings: Settings) -> Erd:
    """The model in a provider's answer."""
    doc = read_answer(spark, asked(provider, prompt, temperature, settings), f"entities array<struct<{ENTITY}>>, relationships array<struct<{RELATION}>>")
    entities = doc.select(F.posexplode("doc.entities").alias("epos", "e")).select("e.*", "epos")
    return flat(entities, doc.select(F.posexplode_outer("doc.relationships").alias("rpos", "r")).filter("rpos is not null").select("r.*", "rpos"))


def discover(tables: Sequence[tuple[str, DataFrame]], truth: Erd, target: str, provider: NamingProvider = NoProvider(), prompt: str = "", settings: Settings = Settings(), scenarios: Sequence[str] = DISCOVERY) -> DataFrame:
    """(target, scenario, run, metric, value) of the data-derived model and, with a provider, of its proposals alone and merged with the data's facts. A proposal that fails is left out. ``scenarios``: which of these to run."""
    spark = tables[0][1].sparkSession
    wanted = _known(scenarios, DISCOVERY)
    base, _, _ = decompose.baseline(tables)
    out = spark.createDataFrame([], RUN)
    if "baseline" in wanted:
        out = out.unionByName(long_form(scores.erd_scores(base, truth), target, "baseline", 0))
    if provider.available() and wanted - {"baseline"}:
        run = 0
        for temperature in settings.temperature_list():
            for _ in range(settings.repeats):
                try:
                    found = asked_erd(spark, provider, prompt, temperature, settings)
                except (RuntimeError, ValueError, KeyError, IndexError):
                    continue
                if "proposal" in wanted:
                    out = out.unionByName(long_form(scores.erd_scores(found, truth), target, "proposal", run))
                if "hybrid" in wanted:
                    out = out.unionByName(long_form(scores.erd_scores(hybrid.merge(base, found), truth), target, "hybrid", run))
                run += 1
    return out


def map_ontology(erd: Erd, gold: dict[str, DataFrame], target: str, provider: NamingProvider = NoProvider(), prompt: str = "", settings: Settings = Settings(), scenarios: Sequence[str] = MAPPING) -> DataFrame:
    """The same for mappings to an ontology: by rules, and with a provider's names on the rules' structure."""
    wanted = _known(scenarios, MAPPING)
    rules = ontology.rule_based(erd)
    reference = ontology.vocabulary_of(gold["concepts"], gold["attributes"])
    score = lambda o: scores.mapping_scores(ontology.vocabulary_of(o["concepts"], o["attributes"]), reference)
    out = erd.entities.sparkSession.createDataFrame([], RUN)
    if "rule_based" in wanted:
        out = out.unionByName(long_form(score(rules), target, "rule_based", 0))
    if provider.available() and "named" in wanted:
        for run, temperature in enumerate(settings.temperature_list()):
            doc = read_answer(erd.entities.sparkSession, asked(provider, prompt, temperature, settings), f"concepts {CONCEPTS}, relations {RELATIONS}")
            named = ontology_tables(doc.select("doc.*"))
            attributes = ontology.with_scaffold(named["attributes"].select("source", "canonical", "pos"), rules["attributes"])
            concepts = ontology.with_scaffold(named["concepts"].select("source", F.col("concept").alias("canonical"), "pos"), rules["concepts"].withColumnRenamed("concept", "canonical")).withColumnRenamed("canonical", "concept")
            out = out.unionByName(long_form(score({"concepts": concepts, "attributes": attributes}), target, "named", run))
    return out


def integrate_models(a: dict[str, DataFrame], b: dict[str, DataFrame], gold: dict[str, DataFrame], instances: tuple[dict[str, DataFrame], dict[str, DataFrame]] | None = None, provider: NamingProvider = NoProvider(), brief: str = "", settings: Settings = Settings()) -> tuple[dict[str, DataFrame], DataFrame]:
    """The integration plan of two ontologies and the metrics (target, scenario, run, metric, value) of all runs; instances (entity tables of both sides) sharpen the matching. gold: pairs, unique, conflicts.

    With a provider its plans are scored too, at each temperature: from the ontologies alone and, if there is a brief, with it.
    """
    overlaps = integrate.value_overlaps(*map(integrate.instance_values, instances)) if instances else None
    prints = [integrate.fingerprints(x["concepts"], x["attributes"]) for x in (a, b)]
    plan = integrate.integrate(checkpointed(prints[0]), checkpointed(prints[1]), overlaps)
    score = lambda p: scores.integration_scores(p["alignments"], p["integrated"], gold["pairs"], gold["unique"], gold["conflicts"])
    out = long_form(score(plan), "a+b", "rule_based", 0)
    if provider.available():
        for scenario, text in [("proposal", "")] + [("proposal_brief", brief)] * bool(brief):
            prompt = integration_prompt(a, b, text)
            for run, temperature in enumerate(settings.temperature_list()):
                try:
                    found = proposed_integration(read_answer(gold["pairs"].sparkSession, asked(provider, prompt, temperature, settings), INTEGRATION))
                    out = out.unionByName(long_form(score(found), "a+b", scenario, run))
                except (RuntimeError, ValueError, KeyError, IndexError):
                    continue
    return plan, out


def proposed_integration(doc: DataFrame) -> dict[str, DataFrame]:
    """The plan in a provider's answer (doc, a row of INTEGRATION), in the form of ``integrate.integrate``."""
    names = lambda c: doc.select(F.explode(f"doc.{c}").alias("name"))
    alignments = doc.select(F.explode("doc.alignments").alias("x")).select("x.canonical", F.col("x.erd_a").alias("a"), F.col("x.erd_b").alias("b"), F.lit(None).cast("double").alias("score"))
    return {"alignments": alignments, "unique_to_a": names("unique_to_a"), "unique_to_b": names("unique_to_b"), "integrated": names("integrated_concepts")}


def contract(doc: DataFrame, erd: Erd) -> DataFrame:
    """(level, issue, item) of a proposal (concepts, relations): errors for wrong categories, sources and mappings, warnings for entities, columns and relations it leaves out."""
    c = F.col
    concepts = doc.select(F.explode("concepts").alias("c")).select("c.*")
    attrs = concepts.select(F.explode("attributes").alias("a")).select("a.source", "a.maps_to.*")
    issue = lambda df, what, item, level="error": df.select(F.lit(level).alias("level"), F.lit(what).alias("issue"), F.coalesce(item, F.lit("")).alias("item"))
    wrong_role = ~c("type").isin("property", "relation_role") | c("type").isNull() | (c("type") == "property") & c("canonical_name").isNull() | (c("type") == "relation_role") & (c("relation").isNull() | c("target_concept").isNull())
    found = issue(concepts.filter(c("ontological_category").isNull() | ~c("ontological_category").isin("kind", "relator", "category")), "category", c("canonical_name"))
    found = found.union(issue(concepts.filter("canonical_name is null or source_entity is null"), "concept", c("source_entity"))).union(issue(attrs.filter(~F.coalesce("source", F.lit("")).rlike(r"^[^.]+\.[^.]+$")), "source", c("source"))).union(issue(attrs.filter(wrong_role), "maps_to", c("source")))
    sources = attrs.select(F.explode(F.split("source", ",")).alias("s")).select(F.trim("s").alias("s")).distinct()
    columns = erd.attributes.select(F.concat_ws(".", "entity", "attr").alias("s"))
    names = concepts.select(c("source_entity").alias("s")).distinct()
    links = erd.attributes.filter("is_fk").select(F.concat_ws(".", "entity", "attr").alias("s"))
    roles = attrs.filter("type = 'relation_role'").select(F.explode(F.split("source", ",")).alias("s")).select(F.trim("s").alias("s")).distinct()
    for rows, known, what in ((erd.entities.select(c("entity").alias("s")), names, "entity_missing"), (columns, sources, "attribute_missing"), (links, roles, "relation_missing")):
        found = found.union(issue(rows.join(known, "s", "left_anti"), what, c("s"), "warning"))
    return found
