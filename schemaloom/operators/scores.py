"""Scores of models, mappings and integrations against a reference, and their mean over runs. Ratios are not rounded; reports round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.names import bare_key, joined_key, last_part, without_prefix
from schemaloom.functions.similarity import f1, share
from schemaloom.operators.assign import greedy_small
from schemaloom.operators.model import Erd

#: Least coverage of an entity's attributes for a match.
MATCH = 0.5


def broad_type(c: Column) -> Column:
    """string, boolean, datetime or numeric by a declared type's name; text types first, dates before numbers."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("char|text|string|clob"), "string").when(t.contains("bool"), "boolean").when(t.rlike("date|time"), "datetime").when(t.rlike("int|num|float|double|dec|real|serial"), "numeric").otherwise(t)


def set_scores(proposed: DataFrame, gold: DataFrame, key: str, empty: float = 1.0) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall, f1 of the distinct keys of two tables."""
    both = proposed.select(F.col(key).alias("k"), F.lit(1).alias("p"), F.lit(0).alias("g")).union(gold.select(F.col(key), F.lit(0), F.lit(1)))
    each = both.groupBy("k").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    sums = each.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("true_positives", F.col("p") * F.col("g")), ("false_positives", F.col("p") * (1 - F.col("g"))), ("false_negatives", F.col("g") * (1 - F.col("p"))))])
    tp = F.col("true_positives")
    out = sums.withColumns({"precision": share(tp, tp + F.col("false_positives"), empty), "recall": share(tp, tp + F.col("false_negatives"), empty)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _attributes(erd: Erd, name: str) -> DataFrame:
    rows = erd.attributes.select(F.col("epos").alias(name), bare_key("attr").alias("attr"), broad_type(F.col("data_type")).alias(f"{name}_type"), "apos")
    return rows.groupBy(name, "attr").agg(F.max_by(f"{name}_type", "apos").alias(f"{name}_type"))


def entity_matches(predicted: Erd, truth: Erd) -> DataFrame:
    """(t, p, coverage): greedy one-to-one matches by the share of the true entity's attributes, ties by more of them, then by later positions."""
    t, p = _attributes(truth, "t"), _attributes(predicted, "p")
    size = t.groupBy("t").agg(F.count(F.lit(1)).alias("size"))
    pairs = t.join(p, "attr").groupBy("t", "p").agg(F.count(F.lit(1)).alias("shared")).join(size, "t").withColumn("coverage", F.col("shared") / F.col("size"))
    return greedy_small(pairs, "t", "p", ["coverage", "shared", "t", "p"]).join(pairs, ["t", "p"]).select("t", "p", "coverage")


def erd_scores(predicted: Erd, truth: Erd, least: float = MATCH) -> DataFrame:
    """One row with the counts and ratios of entities, attributes, keys, types and relationships; empty denominators give 0."""
    found = entity_matches(predicted, truth).filter(F.col("coverage") >= least).cache()
    t, p = _attributes(truth, "t"), _attributes(predicted, "p")
    total = t.agg(F.count(F.lit(1)).alias("attrs"))
    covered = t.join(p.select("attr").distinct(), "attr", "left_semi").agg(F.count(F.lit(1)).alias("covered"))
    shared = t.join(found, "t").join(p, ["p", "attr"]).agg(F.count(F.lit(1)).alias("placed"), F.count_if(F.col("t_type") == F.col("p_type")).alias("types"))
    keys = lambda erd, n: erd.entities.select(F.col("epos").alias(n), F.array_sort(F.array_distinct(F.transform("primary_key", bare_key))).alias(f"{n}_pk"))
    pks = found.join(keys(truth, "t"), "t").join(keys(predicted, "p"), "p").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("t_pk") == F.col("p_pk")).alias("pks"))

    def edges(erd: Erd, n: str) -> DataFrame:
        place = erd.entities.groupBy(bare_key("entity").alias("name")).agg(F.max("epos").alias("e"))
        end = lambda side: F.broadcast(place.select(F.col("name").alias(f"{side}_name"), F.col("e").alias(f"{n}_{side}")))
        rows = erd.relationships.select(bare_key("from_entity").alias("from_name"), bare_key("to_entity").alias("to_name"), bare_key("fk_attribute").alias("fk"))
        return rows.join(end("from"), "from_name").join(end("to"), "to_name")

    side = lambda n: found.select(F.col("t").alias(f"t_{n}"), F.col("p").alias(f"m_{n}"))
    true_edges = edges(truth, "t").join(side("from"), "t_from").join(side("to"), "t_to").select("fk", F.least("m_from", "m_to").alias("a"), F.greatest("m_from", "m_to").alias("b"))
    own = edges(predicted, "p").select("fk", F.least("p_from", "p_to").alias("a"), F.greatest("p_from", "p_to").alias("b")).distinct()
    rels = true_edges.join(own, ["fk", "a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("rels"))
    counts = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    row = total
    for other in (covered, shared, pks, rels, counts(truth.entities, "truth_entities"), counts(predicted.entities, "pred_entities"), counts(truth.relationships, "truth_rels"), counts(predicted.relationships, "pred_rels")):
        row = row.crossJoin(F.broadcast(other))  # one row each
    c = F.col
    row = row.withColumns({"entity_precision": share(c("matched"), c("pred_entities")), "entity_recall": share(c("matched"), c("truth_entities")), "relationship_precision": share(c("rels"), c("pred_rels")), "relationship_recall": share(c("rels"), c("truth_rels"))})
    return row.select(
        "pred_entities", "truth_entities", c("matched").alias("matched_entities"), "entity_precision", "entity_recall", f1(c("entity_precision"), c("entity_recall")).alias("entity_f1"),
        share(c("covered"), c("attrs")).alias("attribute_coverage"), share(c("placed"), c("attrs")).alias("attribute_placement"), share(c("pks"), c("matched")).alias("pk_accuracy"), share(c("types"), c("placed")).alias("type_accuracy"),
        "relationship_precision", "relationship_recall", f1(c("relationship_precision"), c("relationship_recall")).alias("relationship_f1"),
    )


def relation_agrees(gold: Column, proposed: Column) -> Column:
    """Whether a proposed relation name holds the gold one, also after is, has or get."""
    return (proposed == gold) | F.contains(proposed, gold) | (without_prefix(proposed) == gold)


def collapses(mappings: DataFrame, key: str, other: str) -> DataFrame:
    """One row: for each ``key`` the different values of ``other`` beyond the first, added up."""
    each = mappings.groupBy(key).agg(F.count_distinct(other).alias("n"))
    return each.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("collapsed"))


def mapping_scores(proposed: dict[str, DataFrame], gold: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """One row with the fourteen measures of a mapping.

    Each side has entities (source_entity, canonical, category, seq), mappings (attribute, canonical, mapping_type, accepted
    array, seq; of several for a name the last counts) and terms (name, description, synonyms, sources arrays). Precision and recall look at source elements only.
    ``strict`` compares bare attribute names in the under-merge rate; by default qualified gold names find no partner there.
    """
    low = lambda c: F.lower(F.trim(c))

    def sides(x: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
        e = x["entities"].select(low("source_entity").alias("src"), joined_key("canonical").alias("label"), F.col("category"), "seq")
        m = x["mappings"].select(low("attribute").alias("attr"), last_part(low("attribute")).alias("bare"), joined_key("canonical").alias("label"), low("canonical").alias("term"), "mapping_type", F.coalesce("accepted", F.array().cast("array<string>")).alias("accepted"), "seq")
        t = x["terms"].select(joined_key("name").alias("name"), low(F.coalesce("description", F.lit(""))).alias("description"), F.array_distinct(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), joined_key)).alias("synonyms"), F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: last_part(low(s))).alias("sources"))
        return e, m, t

    (pe, pm, pt), (ge, gm, gt) = sides(proposed), sides(gold)
    elements = lambda e, m: e.select(F.concat(F.lit("e:"), "src").alias("k"), F.col("src").alias("name")).union(m.select(F.concat(F.lit("a:"), "bare"), "bare"))
    row = set_scores(elements(pe, pm), elements(ge, gm), "k").drop("false_positives", "false_negatives", "true_positives")
    missing = lambda a, b, n: a.join(b, "k", "left_anti").agg(F.count_distinct("name").alias(n))
    last = lambda m, key: m.groupBy(key).agg(F.max_by("label", "seq").alias("p_label"))
    one = lambda df, n, test: df.agg(F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).alias(n), F.count(F.lit(1)).alias(f"{n}_of"))
    entity_ops = one(ge.join(last(pe, "src"), "src", "left"), "entity_ops", ~F.col("p_label").eqNullSafe(F.col("label")))
    attr_ops = one(gm.join(last(pm, "bare"), "bare", "left"), "attr_ops", ~F.col("p_label").eqNullSafe(F.col("label")))
    terms = gt.select("name", F.col("description").alias("gd"), F.col("synonyms").alias("gs")).join(pt.select("name", F.col("description").alias("pd"), F.col("synonyms").alias("ps")), "name", "full_outer")
    sym = F.size(F.array_except("gs", "ps")) + F.size(F.array_except("ps", "gs"))
    ops = F.when(F.col("gd").isNull() | F.col("pd").isNull(), 1).otherwise(F.when(F.col("gd") != F.col("pd"), 1).otherwise(0) + sym)
    term_ops = terms.agg(F.coalesce(F.sum(ops), F.lit(0)).alias("term_ops"))
    over = collapses(pm.select(F.col("term").alias("p_term"), "attr").join(gm.select("attr", "term"), "attr"), "p_term", "term").withColumnRenamed("collapsed", "over")
    partner = gm.select(F.col("term").alias("g_term"), (F.col("bare") if strict else F.col("attr")).alias("bare")).join(last(pm, "bare"), "bare")
    under = collapses(partner, "g_term", "p_label").withColumnRenamed("collapsed", "under")
    grounded = gm.select(F.col("bare").alias("s")).union(ge.select("src")).distinct()
    alive = pt.select("name", F.explode("sources").alias("s")).join(grounded, "s", "left_semi").select("name").distinct()
    ghosts = one(pt.filter(F.size("sources") > 0).join(alive, "name", "left_anti"), "ghosts", F.lit(True)).drop("ghosts_of")
    prov = lambda t, n: one(t, n, F.size("sources") > 0)
    re_entities = one(ge.filter(joined_key("src") != F.col("label")).join(last(pe, "src"), "src", "left"), "ref_e", F.col("p_label").eqNullSafe(F.col("label")))
    own = pm.groupBy("attr").agg(F.collect_set("label").alias("labels"))
    accepted = F.array_union(F.array("label"), F.transform("accepted", joined_key))
    agreed = F.exists(accepted, lambda g: F.exists("labels", lambda p: relation_agrees(g, p)))
    re_attrs = one(gm.filter(joined_key("bare") != F.col("label")).join(own, "attr", "left"), "ref_a", F.coalesce(agreed, F.lit(False)))
    kinds = pm.groupBy("attr").agg(F.max_by(F.coalesce("mapping_type", F.lit("property")), "seq").alias("p_type"))
    types = one(gm.filter(F.col("mapping_type").isNotNull()).join(kinds, "attr", "left"), "types", F.coalesce("p_type", F.lit("property")) == F.col("mapping_type"))
    cats = pe.groupBy("src").agg(F.max_by(F.coalesce("category", F.lit("kind")), "seq").alias("p_cat"))
    categories = one(ge.filter(F.col("category").isNotNull()).join(cats, "src", "left"), "cats", F.coalesce("p_cat", F.lit("kind")) == F.col("category"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    for other in (missing(elements(pe, pm), elements(ge, gm), "false_positives"), missing(elements(ge, gm), elements(pe, pm), "false_negatives"), entity_ops, attr_ops, term_ops, over, under, ghosts, prov(pt, "p_prov"), prov(gt, "g_prov"), re_entities, re_attrs, types, categories, count(pm, "n_mappings")):
        row = row.crossJoin(F.broadcast(other))  # one row each
    c = F.col
    none = lambda part, whole: F.when(whole > 0, part / whole)
    return row.select(
        "precision", "recall", "f1", "false_positives", "false_negatives", share(c("entity_ops") + c("attr_ops") + c("term_ops"), c("g_prov_of")).alias("curation_effort"),
        share(c("over"), c("n_mappings")).alias("over_merge_rate"), share(c("under"), c("n_mappings")).alias("under_merge_rate"), share(c("ghosts"), c("p_prov_of")).alias("hallucination_rate"),
        share(c("g_prov"), c("g_prov_of"), 1.0).alias("provenance_completeness"), share(c("p_prov"), c("p_prov_of"), 1.0).alias("proposed_provenance_completeness"),
        none(c("ref_e") + c("ref_a"), c("ref_e_of") + c("ref_a_of")).alias("refinement_accuracy"), none(c("types"), c("types_of")).alias("type_accuracy"), none(c("cats"), c("cats_of")).alias("category_accuracy"),
    )


def audit(proposed: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """(key, proposed_label, gold_label, status, refinement): each element of either side; TP, FP or FN, and for TP whether the labels match."""
    p = proposed.select(F.col(key), F.col(label).alias("proposed_label"), F.lit(True).alias("_p"))
    g = gold.select(F.col(key), F.col(label).alias("gold_label"), F.lit(True).alias("_g"))
    both = p.join(g, key, "full_outer")
    status = F.when(F.col("_p").isNull(), "FN").when(F.col("_g").isNull(), "FP").otherwise("TP")
    same = joined_key("proposed_label") == joined_key("gold_label")
    return both.withColumn("status", status).select(key, "proposed_label", "gold_label", "status", F.when(F.col("status") == "TP", F.when(same, "match").otherwise("mismatch")).alias("refinement"))


def integration_scores(alignments: DataFrame, integrated: DataFrame, gold_pairs: DataFrame, gold_unique: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row with the measures of an integration.

    alignments: (a, b); integrated: (name) of all concepts in the output; gold_pairs: (canonical, a, b); gold_unique:
    (side a or b, name); conflicts: (type, canonical, detail). No gold pairs at all is an error, not a perfect score.
    """
    if gold_pairs.isEmpty():
        raise ValueError("there is no gold to score against")
    low = lambda c: F.lower(F.trim(c))
    pair = lambda df: df.select(F.least(low("a"), low("b")).alias("a"), F.greatest(low("a"), low("b")).alias("b")).filter("a <> '' and b <> ''").distinct()
    proposed, gold = pair(alignments), pair(gold_pairs)
    key = F.concat_ws("|", "a", "b").alias("k")
    row = set_scores(proposed.select(key), gold.select(key), "k")
    ends = proposed.select(F.col("a").alias("x"), F.col("b").alias("y")).union(proposed.select("b", "a")).distinct()
    merged = ends.alias("l").join(ends.alias("r"), (F.col("l.x") == F.col("r.x")) & (F.col("l.y") < F.col("r.y"))).select(F.col("l.y").alias("a"), F.col("r.y").alias("b"))
    over = merged.join(gold, ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("over"))
    names = integrated.select(joined_key("name").alias("name")).distinct().withColumn("kept", F.lit(1))
    kept = gold_unique.select("side", joined_key("name").alias("name")).distinct().join(names, "name", "left").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ab"], *[F.count_if((F.col("side") == s) & F.col("kept").isNotNull()).alias(f"kept_{s}") for s in "ab"])
    said = F.filter(F.transform(F.split("detail", ";"), lambda p: F.when(F.contains(p, F.lit(":")), F.trim(F.regexp_replace(p, "^[^:]*:", "")))), lambda p: p.isNotNull())
    rows = conflicts.filter(F.col("type").isin("naming", "identity", "granularity", "structure")).withColumns({"i": F.monotonically_increasing_id(), "said": said, "canon": joined_key("canonical"), "head": joined_key(F.substring_index("canonical", ".", 1))})
    of_gold = gold_pairs.groupBy(joined_key("canonical").alias("canon")).agg(F.min_by(F.struct("a", "b"), "a").alias("g"))
    rows = rows.join(of_gold, "canon", "left")
    by_pair = F.when((F.col("type") == "naming") & (F.size("said") >= 2), F.struct(F.get("said", F.lit(0)).alias("a"), F.get("said", F.lit(1)).alias("b"))).when(F.col("type") == "identity", F.col("g"))
    rows = rows.withColumn("pair", by_pair).withColumn("need", F.when(F.col("type").isin("naming", "identity"), F.col("canon")).otherwise(F.col("head")))
    rows = rows.withColumns({"a": F.least(F.lower("pair.a"), F.lower("pair.b")), "b": F.greatest(F.lower("pair.a"), F.lower("pair.b"))})
    rows = rows.join(proposed.withColumn("aligned", F.lit(1)), ["a", "b"], "left").join(names.withColumnRenamed("name", "need"), "need", "left")
    solved = rows.agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(F.when(F.col("pair").isNotNull(), F.col("aligned").isNotNull()).otherwise(F.col("kept").isNotNull())).alias("solved"))
    for other in (over, kept, solved):
        row = row.crossJoin(F.broadcast(other))
    c = F.col
    proposed_n, gold_n = c("true_positives") + c("false_positives"), c("true_positives") + c("false_negatives")
    return row.select("precision", "recall", "f1", share(c("over"), proposed_n).alias("over_merge_rate"), share(c("false_negatives"), gold_n).alias("under_merge_rate"), share(c("kept_a"), c("n_a"), 1.0).alias("unique_a_coverage"), share(c("kept_b"), c("n_b"), 1.0).alias("unique_b_coverage"), share(c("solved"), c("conflicts"), 1.0).alias("conflict_resolution_accuracy"))


def over_runs(values: DataFrame) -> DataFrame:
    """(target, scenario, metric, mean, std, runs) of (target, scenario, run, metric, value): population deviation, nulls left out."""
    return values.filter("value is not null").groupBy("target", "scenario", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("runs"))
