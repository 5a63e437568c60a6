"""Texts of prompts, built from statistics and models. The wording is our own; what it must hold is tested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from schemaloom.operators.model import Erd
from schemaloom.operators.ontology import erd_text, ontology_text
from schemaloom.operators.profile import prompt_statistics
from schemaloom.operators.sampling import head_middle_tail

TASKS = {
    "erd": "Give the entities, their attributes, primary keys and relationships of this table as JSON.",
    "ontology": "Give an ontology of this model as JSON: concepts with categories, and for each column a property or a relation.",
    "integrate": "Align the concepts of these two ontologies and give the integrated one as JSON.",
}


def table_text(df: DataFrame, header: bool = True) -> str:
    """Rows of a sample as comma-separated lines; df is a sample of some rows."""
    lines = [",".join("" if v is None else str(v) for v in r) for r in df.collect()]
    return "\n".join([",".join(df.columns), *lines] if header else lines)


def statistics_text(df: DataFrame) -> str:
    rows = prompt_statistics(df).orderBy("pos").collect()
    return "\n".join(f"- {r['col']} ({r['dtype']}): {r['unique_count']} different, {r['null_count']} empty{', unique' if r['is_unique_candidate'] else ''}; e.g. {', '.join(r['sample_values'])}" for r in rows)


def erd_prompt(df: DataFrame, order: Sequence[str], base: Erd | None = None, instructions: str = "", history: Sequence[str] = (), level: int = 2) -> str:
    """The prompt for a model of a table. Level 1 shows rows only, 2 the names too, 3 a brief with them; base grounds it."""
    sample = head_middle_tail(df, order)
    parts = [TASKS["erd"], f"Rows:\n{table_text(sample.orderBy(*order), level > 1)}"]
    if level > 1:
        parts.append(f"Columns:\n{statistics_text(df)}")
    if level > 2 and instructions:
        parts.append(f"Brief:\n{instructions}")
    if base is not None:
        parts.append(f"Found in the data:\n{erd_text(base).first()[0]}")
    parts += [f"Before:\n{h}" for h in history]
    return "\n\n".join(parts)


#: What an ontology's answer must keep to: where it is measured as it is, and where a run goes on with it.
CONTRACTS = {
    True: 'Answer with one JSON object {"concepts": [...], "relations": [...]}. Every source is Entity.column, each column once; a composite reference lists its columns with commas. Categories are kind, relator or category; maps_to has the type property or relation_role.',
    False: 'Answer with one JSON object {"concepts": [...], "relations": [...]}. Reuse terms of the vocabulary where they mean the same; give new ones a short name that does not repeat its entity.',
}


def _terms_text(terms: DataFrame) -> str:
    return "\n".join(f"- {r['name']}: {r['description'] or ''}" for r in terms.orderBy("name").collect())


def hints_text(unpacking: dict[str, DataFrame]) -> str:
    """What entities and columns are likely to be, a line for each."""
    kinds = [f"- {r['entity']}: {r['kind']}" for r in unpacking["entities"].orderBy("entity").collect()]
    roles = [f"- {r['entity']}.{r['attr']}: {r['role']}, e.g. {r['preferred']}" for r in unpacking["attributes"].orderBy("entity", "attr").collect()]
    return "\n".join([*kinds, *roles])


def ontology_prompt(
    erd: Erd, brief: str = "", terms: DataFrame | None = None, scaffold: dict[str, DataFrame] | None = None, unpacking: dict[str, DataFrame] | None = None, previous: DataFrame | None = None,
    history: Sequence[str] = (), refinement: str = "", compare: bool = False,
) -> str:
    """The prompt for an ontology of a model: the contract of its answer, the vocabulary that exists, a fixed structure to name, hints, the vocabulary before with what was asked then, and what to refine."""
    parts = [TASKS["ontology"], CONTRACTS[compare], erd_text(erd).first()[0]]
    if brief:
        parts.append(f"Brief:\n{brief}")
    if terms is not None:
        parts.append("Vocabulary:\n" + _terms_text(terms))
    if scaffold is not None:
        parts.append("Keep this structure, improve its names:\n" + ontology_text(scaffold["concepts"], scaffold["attributes"], "scaffold").first()[0])
    if unpacking is not None:
        parts.append("Hints:\n" + hints_text(unpacking))
    if previous is not None:
        parts.append("Vocabulary before:\n" + _terms_text(previous))
    parts += [f"Asked before:\n{h}" for h in history]
    return "\n\n".join([*parts, f"Refine: {refinement}"] if refinement else parts)


def integration_prompt(a: dict[str, DataFrame], b: dict[str, DataFrame], brief: str = "") -> str:
    parts = [TASKS["integrate"], ontology_text(a["concepts"], a["attributes"], "A").first()[0], ontology_text(b["concepts"], b["attributes"], "B").first()[0]]
    return "\n\n".join([*parts, f"Brief:\n{brief}"] if brief else parts)
