"""Queries on models and vocabularies: matching, scores, hygiene, integration, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import assign, hybrid, integrate, ontology, scores
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.model import of_rows
from schemaloom.queries.common import sql_close, sql_jaccard, sql_joined, sql_key, sql_tokens, table
from schemaloom.queries.names import _CAPITAL, _TERM
from schemaloom.queries.fixtures import ERD_BASE, ERD_PROPOSAL, ERD_TRUTH, GOLD_CONCEPTS, ONTOLOGY_A, ONTOLOGY_B
from schemaloom.sources.files import proposal

_flat = lambda c: F.array_join(c, ",")


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and suppliers one to one, those first that most was sold of."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_BRAND).alias("i")), "l_partkey")
    pairs = sold.groupBy("i", F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("score"))
    return assign.greedy(pairs, "i", "j", ["score", "i", "j"])


_BRAND = "cast(substr(p_brand, 7) as int)"
_GREEDY_PAIRS = f"SELECT {_BRAND} AS l, l_suppkey AS r, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def greedy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations against regions by the edit distance of their names, as one fold."""
    pairs = table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).select("n_nationkey", "r_regionkey", (-F.levenshtein("n_name", "r_name")).alias("score"))
    return assign.greedy_small(pairs, "n_nationkey", "r_regionkey", ["score", "n_nationkey", "r_regionkey"])


_GREEDY = """WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY score DESC, l DESC, r DESC) AS i FROM ({pairs})),
    w(i, ls, rs, took) AS (SELECT 0, []::BIGINT[], []::BIGINT[], false UNION ALL
        SELECT p.i, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END, NOT (list_contains(ls, l) OR list_contains(rs, r)) FROM w JOIN p ON p.i = w.i + 1)
    SELECT {out} FROM p JOIN w USING (i) WHERE took"""


def value_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared values of entities as a share of all: nations of customers and suppliers, users of events and orders."""
    a = {"customer": table(spark, sf_dir, "customer").select("c_nationkey"), "events": table(spark, sf_dir, "events").select("user_id")}
    b = {"supplier": table(spark, sf_dir, "supplier").select("s_nationkey"), "orders": table(spark, sf_dir, "orders").select("o_custkey")}
    return integrate.value_overlaps(integrate.instance_values(a), integrate.instance_values(b))


def concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of brands of the even and of the odd parts, by their names, the types they link to and the names of their parts."""
    return integrate.pair_scores(*_brands(spark, sf_dir)).select("a", "b", "score")


def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.align(integrate.pair_scores(*_brands(spark, sf_dir))).select("a", "b", "score")


#: A brand as a concept of either side: its name, category and source.
_CONCEPT = (("concat('Brand ', {n})", "CASE {n} % 3 WHEN 0 THEN 'relator' WHEN 1 THEN 'kind' ELSE 'category' END"), ("concat('brand-', {n} + {n} % 4)", "CASE {n} % 2 WHEN 0 THEN 'Relator' ELSE 'kind' END"))


def _brands(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    out = []
    for side, (name, category) in enumerate(_CONCEPT):
        rows = table(spark, sf_dir, "part").filter(f"p_partkey % 2 = {side}").withColumn("n", F.expr(_BRAND))
        keyed = rows.select("n", F.expr("CASE WHEN p_size > 25 THEN 'relation_role' ELSE 'property' END").alias("mapping_type"), F.col("p_name").alias("canonical"), F.col("p_type").alias("target"))
        concepts = rows.groupBy("n").agg(F.min("p_brand").alias("source")).select(F.expr(name.format(n="n")).alias("concept"), F.col("n").alias("pos"), F.expr(category.format(n="n")).alias("category"), "source")
        attributes = keyed.select(F.expr(name.format(n="n")).alias("concept"), "mapping_type", "canonical", "target")
        out.append(integrate.fingerprints(concepts, attributes))
    return out


def _brand_sql(n: str, side: int) -> str:
    name, category = _CONCEPT[side]
    mine = f"(SELECT *, {_BRAND} AS n FROM part WHERE p_partkey % 2 = {side})"
    return f"""c{n} AS (SELECT c.concept, c.pos, {sql_joined('c.category')} AS category, c.source, coalesce(p, []) AS p, coalesce(t, []) AS t FROM (SELECT {name.format(n='n')} AS concept, n AS pos, {category.format(n='n')} AS category, min(p_brand) AS source FROM {mine} GROUP BY n) c
        LEFT JOIN (SELECT {name.format(n='n')} AS concept, list(DISTINCT {sql_joined('p_name')}) FILTER (p_size <= 25) AS p, list(DISTINCT {sql_joined('p_type')}) FILTER (p_size > 25) AS t FROM {mine} GROUP BY 1) s USING (concept))"""


def _ontology(spark: SparkSession, rows: tuple) -> dict[str, DataFrame]:
    concepts, attributes = rows
    return {
        "concepts": spark.createDataFrame([(c, i, k, s) for i, (c, k, s) in enumerate(concepts)], "concept string, pos int, category string, source string"),
        "attributes": spark.createDataFrame([(*a, i) for i, a in enumerate(attributes)], "concept string, source string, mapping_type string, canonical string, target string, accepted array<string>, pos int"),
    }


def _prints(spark: SparkSession) -> list[DataFrame]:
    return [integrate.fingerprints(**_ontology(spark, x)) for x in (ONTOLOGY_A, ONTOLOGY_B)]


_SCORED = f"""{_brand_sql('a', 0)}, {_brand_sql('b', 1)}, scored AS (SELECT a.pos AS l, b.pos AS r, a.concept AS a, b.concept AS b,
    0.3::DOUBLE * (0.5::DOUBLE * {sql_close(sql_joined('a.concept'), sql_joined('b.concept'))} + 0.5::DOUBLE * {sql_jaccard(sql_tokens('a.concept'), sql_tokens('b.concept'))})
    + 0.5::DOUBLE * (0.34::DOUBLE * CASE WHEN a.category = b.category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.33::DOUBLE * {sql_jaccard('a.t', 'b.t')} + 0.33::DOUBLE * {sql_jaccard('a.p', 'b.p')}) + 0.2::DOUBLE * 0.0::DOUBLE AS score FROM ca a CROSS JOIN cb b)"""


def best_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders the surest mapping: highest rounded price, then a reason, then the latest; some prices are null."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("Cust."), F.col("o_custkey").cast("string")).alias("attribute"), F.nullif(F.floor(F.col("o_totalprice") / 50000).cast("double"), F.lit(2.0)).alias("confidence"), F.when(F.col("o_orderstatus") == "F", "shipped").alias("rationale"), F.col("o_orderkey").alias("seq"))
    return voc.best_mappings(o)


def vote_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flag that most line items of a supplier have."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Line.s"), F.col("l_suppkey").cast("string")).alias("attribute"), F.col("l_returnflag").alias("canonical"))
    return voc.votes(li)


def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels by id."""
    return scores.set_scores(table(spark, sf_dir, "labels").filter("quality = 1"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id")


def audit_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against documents, item by item, labels as text."""
    proposed = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "src-1").otherwise("Src 2").alias("label"))
    return scores.audit(proposed, table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label")), "doc_id", "label")


def over_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses beyond the first for each priority, and priorities beyond the first for each customer."""
    o = table(spark, sf_dir, "orders")
    a, b = scores.collapses(o, "o_orderpriority", "o_orderstatus"), scores.collapses(o, "o_custkey", "o_orderpriority")
    return a.select(F.lit("status").alias("what"), "collapsed").union(b.select(F.lit("priority"), "collapsed"))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of whole event values by type; the runs are users."""
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("target"), F.col("event_type").alias("scenario"), F.col("user_id").alias("run"), F.lit("parity").alias("metric"), (F.col("event_id") % 2).cast("double").alias("value"))
    out = scores.over_runs(e)
    return out.select("target", "scenario", "metric", F.floor(F.col("mean") * 1e9).cast("long").alias("mean_e9"), F.floor(F.col("std") * 1e6).cast("long").alias("std_e6"), "runs")


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of events as it is, with words around it, and broken."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is: "), "props", F.lit(" — done."))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.substring("props", 1, 3)).alias("answer"))
    return proposal(e, "k int").select("event_id", F.col("doc.k").alias("k"))


def archived_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as terms, orders as their mappings: how many are kept and archived."""
    terms = table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"))
    used = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("canonical"))
    kept, gone = voc.archive(terms, used)
    return kept.select(F.lit("kept").alias("state"), "name").union(gone.select(F.lit("archived"), "name"))


#: Columns, mappings and terms as the parts give them; the expressions mean the same in Spark and DuckDB. Of six mappings one is exact, one has other case, three name entities that lack the column or don't exist, one a column that doesn't exist.
_ATTR = "concat(replace(p_name, ' ', '_'), '_', p_partkey)"
_COLUMNS = {"entity": "p_type", "attr": _ATTR, "epos": "ascii(p_type)", "apos": "cast(p_partkey as int)"}
_MAPPINGS = {
    "attribute": f"CASE p_partkey % 6 WHEN 0 THEN concat(p_type, '.', {_ATTR}) WHEN 1 THEN concat(lower(p_type), '.', upper({_ATTR})) WHEN 2 THEN concat('PROMO.', {_ATTR}) WHEN 3 THEN concat('Gone.', {_ATTR}) WHEN 4 THEN concat(p_type, '.none_', p_partkey) ELSE concat('Gone.', upper({_ATTR})) END",
    "canonical": "CASE p_size % 4 WHEN 0 THEN concat(p_name, ' ', p_size) WHEN 1 THEN upper(concat(p_name, ' ', p_size)) WHEN 2 THEN concat('Kind ', p_brand) ELSE concat('new ', p_size) END",
    "confidence": "cast(p_size % 10 as double) / 10", "rationale": "''", "seq": "p_partkey",
}
_SOURCE = f"CASE p_partkey % 4 WHEN 0 THEN concat('Gone.', {_ATTR}) ELSE concat(p_type, '.', {_ATTR}) END"
#: New terms: some have a synonym of many terms as their name, some a term's name in capitals, some are new.
_NEW = {
    "name": "CASE p_partkey % 4 WHEN 0 THEN concat('kind ', p_brand) WHEN 1 THEN upper(concat(p_name, ' ', p_size)) ELSE concat('fresh ', p_partkey) END", "description": "CASE p_size % 2 WHEN 0 THEN 'a longer description' ELSE '' END",
}
_select = lambda rules: ", ".join(f"{x} AS {n}" for n, x in rules.items())


def _part(spark: SparkSession, sf_dir: str, rules: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{x} AS {n}" for n, x in rules.items()])


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, _COLUMNS)


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, _MAPPINGS)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("pos"), F.max("p_brand").alias("brand"), F.array_sort(F.collect_set(F.expr("concat('kind ', p_brand)"))).alias("synonyms"), F.sort_array(F.collect_list(F.struct("p_partkey", F.expr(_SOURCE).alias("s")))).alias("x"))
    return rows.select(F.expr("concat(p_name, ' ', p_size)").alias("name"), F.expr("CASE WHEN pos % 3 = 0 THEN '' ELSE brand END").alias("description"), "synonyms", F.transform("x", lambda x: x["s"]).alias("sources"), "pos")


def _new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter("p_partkey % 9 = 0")
    return rows.selectExpr(*[f"{x} AS {n}" for n, x in _NEW.items()], "array(concat('KIND ', p_brand), concat('other ', p_size)) AS synonyms", f"array(concat(p_type, '.', {_ATTR})) AS sources", "p_partkey AS pos")


_VOC = f"""attrs AS (SELECT {_select(_COLUMNS)} FROM part), mp AS (SELECT {_select(_MAPPINGS)} FROM part),
    tm AS (SELECT concat(p_name, ' ', p_size) AS name, CASE WHEN min(p_partkey) % 3 = 0 THEN '' ELSE max(p_brand) END AS description, list_sort(list(DISTINCT concat('kind ', p_brand))) AS synonyms,
        list({_SOURCE} ORDER BY p_partkey) AS sources, min(p_partkey) AS pos FROM part GROUP BY p_name, p_size)"""
_NEW_SQL = f"""nw AS (SELECT arg_max(name, pos) AS name, arg_max(description, pos) AS description, arg_max(synonyms, pos) AS synonyms, arg_max(sources, pos) AS sources, min(pos) AS pos
    FROM (SELECT {_select(_NEW)}, [concat('KIND ', p_brand), concat('other ', p_size)] AS synonyms, [concat(p_type, '.', {_ATTR})] AS sources, p_partkey AS pos FROM part WHERE p_partkey % 9 = 0) GROUP BY lower(name))"""
_q = lambda x: "'" + str(x).replace("'", "''") + "'"
_QK = lambda x: f"({sql_key(f'split_part({x}, chr(46), 1)')} || '.' || {sql_key(f'{x}[strpos({x}, chr(46)) + 1:]')})"


def valid_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.valid_mappings(_maps(spark, sf_dir), _attrs(spark, sf_dir)).select("attribute", "canonical")


def repaired_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that the model lacks, ones that it has, columns with and without the same spelling, and none."""
    return voc.repaired_prefixes(_maps(spark, sf_dir), _attrs(spark, sf_dir)).select("attribute", "canonical")


def filled_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without a mapping take what most columns of their name have, a term of their name, or a new one; a third of the terms has sources."""
    terms = _terms(spark, sf_dir).withColumn("sources", F.when(F.col("pos") % 3 == 0, F.col("sources")).otherwise(F.array().cast("array<string>")))
    some = _maps(spark, sf_dir).filter("seq % 6 in (0, 1, 2)")
    return voc.covered(some, _attrs(spark, sf_dir), terms).select("attribute", "canonical", "confidence", "source")


def filled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without a mapping: approved before, equal by name, by words, new, and equal to one that was new before it."""
    known = spark.createDataFrame([("Flight", "Air Trip"), ("Plane", "Airport"), ("Person", "Passenger Person")], "source_entity string, canonical string")
    approved = spark.createDataFrame([("Lounge", "Waiting Room")], "source_entity string, canonical string")
    entities = spark.createDataFrame([("flight", 0), ("AIRPORT", 1), ("person passengers", 2), ("crewMember", 3), ("crew_members", 4), ("LOUNGE", 5)], "entity string, epos int")
    return voc.covered_entities(known, entities, approved).select("source_entity", "canonical", "confidence")


def fresh_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.stale_sources(_terms(spark, sf_dir), _attrs(spark, sf_dir)).select("name", _flat("sources").alias("sources"))


def merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms join existing ones over names and synonyms; the newest sources count."""
    return voc.merge_terms(_terms(spark, sf_dir), _new_terms(spark, sf_dir)).select("name", "description", _flat("synonyms").alias("synonyms"), _flat("sources").alias("sources"))


def remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.remapped(_maps(spark, sf_dir), _terms(spark, sf_dir)).select("attribute", "canonical")


def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.aligned_terms(_terms(spark, sf_dir), _maps(spark, sf_dir)).select("name", _flat("sources").alias("sources"), F.col("pos").cast("long").alias("pos"))


def owned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.owned_sources(_terms(spark, sf_dir), _maps(spark, sf_dir)).select("name", _flat("sources").alias("sources"))


def short_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of spare parts without the leading words that all their entities share and no column needs."""
    part = table(spark, sf_dir, "part")
    terms = part.groupBy(F.expr(_SPARE["name"]).alias("name")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.expr(f"concat({_SPARE['entity']}, '.', {_SPARE['attr']})").alias("s")))).alias("x"), F.min("p_partkey").alias("pos"))
    return voc.abstracted(terms.select("name", F.transform("x", lambda x: x["s"]).alias("sources"), "pos")).select("pos", "name", "short")


_SPARE = {
    "name": "concat(CASE p_size % 4 WHEN 0 THEN 'Spare Part ' WHEN 1 THEN 'sparePart ' WHEN 2 THEN 'Part ' ELSE '' END, p_name, CASE p_size % 3 WHEN 0 THEN '' ELSE concat(' ', p_size) END)",
    "entity": "concat(CASE p_partkey % 9 WHEN 0 THEN 'Part' ELSE 'Spare Parts' END, ' ', lower(p_type))", "attr": "CASE p_partkey % 7 WHEN 0 THEN concat('spare_', replace(p_name, ' ', '_')) WHEN 1 THEN 'part' ELSE replace(p_name, ' ', '_') END",
}


def plain_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.plain_vocabulary(_attrs(spark, sf_dir)).select("name", _flat("synonyms").alias("synonyms"), _flat("sources").alias("sources"), "confidence")


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the merged model with type and provenance, and its relationships."""
    m = hybrid.merge(of_rows(spark, ERD_BASE), of_rows(spark, ERD_PROPOSAL))
    a = m.attributes.select(F.lit("attribute").alias("kind"), "entity", F.col("attr").alias("name"), F.col("data_type").alias("detail"), "prov")
    return a.union(m.relationships.select(F.lit("relationship"), "from_entity", "fk_attribute", "to_entity", "prov")).union(m.entities.select(F.lit("key"), "entity", _flat("primary_key"), F.lit(""), "pk_prov"))


def mapping_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' mapping of a small model against an expert's."""
    rules, gold = ontology.rule_based(of_rows(spark, ERD_TRUTH)), _ontology(spark, GOLD_CONCEPTS)
    return scores.mapping_scores(ontology.vocabulary_of(rules["concepts"], rules["attributes"]), ontology.vocabulary_of(gold["concepts"], gold["attributes"]))


def integration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = integrate.integrate(*_prints(spark))
    pairs = spark.createDataFrame([("Flight", "Flight", "flights"), ("Passenger", "Passenger", "people"), ("Plane", "Airplane", "aircraft")], "canonical string, a string, b string")
    unique = spark.createDataFrame([("a", "Gate"), ("b", "Fare"), ("b", "Meal")], "side string, name string")
    conflicts = spark.createDataFrame([("naming", "Plane", "A: Airplane; B: Aircraft"), ("identity", "Flight", "A: natural key; B: id"), ("granularity", "Gate.number", ""), ("structure", "Meal.kind", ""), ("other", "x", "")], "type string, canonical string, detail string")
    return scores.integration_scores(plan["alignments"], plan["integrated"], pairs, unique, conflicts)


_names = (greedy_match, greedy_fold, value_jaccard, concept_scores, concept_match, best_mappings, vote_winner, set_scores, audit_outer, over_merge, run_statistics, json_answers, archived_terms, valid_mappings, repaired_prefixes, filled_mappings, filled_entities, fresh_sources, merged_terms, remapped, new_terms, owned_sources, short_terms, plain_vocabulary, hybrid_merge, mapping_scores, integration_scores)
QUERIES = {f.__name__: f for f in _names}


def _rows(columns: str, *rows: tuple) -> str:
    """Results worked out by hand."""
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, bool) else _q(x) if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({columns})"


ORACLE = {
    "greedy_match": _GREEDY.format(pairs=_GREEDY_PAIRS, out="l AS i, r AS j, score"),
    "greedy_fold": _GREEDY.format(pairs="SELECT n_nationkey AS l, r_regionkey AS r, -levenshtein(n_name, r_name) AS score FROM nation CROSS JOIN region", out="l AS n_nationkey, r AS r_regionkey"),
    "value_jaccard": " UNION ALL ".join(f"SELECT '{a}' AS a_source, '{b}' AS b_source, CAST(s AS DOUBLE) / (x + y - s) AS instance FROM (SELECT (SELECT count(DISTINCT {u}) FROM {a}) AS x, (SELECT count(DISTINCT {v}) FROM {b}) AS y, (SELECT count(*) FROM (SELECT {u} FROM {a} INTERSECT SELECT {v} FROM {b})) AS s) WHERE s > 0" for a, u in (("customer", "c_nationkey"), ("events", "user_id")) for b, v in (("supplier", "s_nationkey"), ("orders", "o_custkey"))),
    "concept_scores": f"WITH {_SCORED} SELECT a, b, score FROM scored",
    "concept_match": _GREEDY.replace("WITH RECURSIVE p", f"WITH RECURSIVE {_SCORED.replace('{', '{{').replace('}', '}}')}, p").format(pairs="SELECT * FROM scored WHERE score >= 0.35", out="a, b, score"),
    "best_mappings": "SELECT attribute, confidence, rationale, seq FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY coalesce(confidence, -1) DESC, (rationale IS NOT NULL) DESC, seq DESC) AS r FROM (SELECT 'Cust.' || o_custkey AS attribute, nullif(floor(o_totalprice / 50000), 2.0) AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'shipped' END AS rationale, o_orderkey AS seq FROM orders)) WHERE r = 1",
    "vote_winner": "SELECT part, name, votes FROM (SELECT 's' || l_suppkey AS part, l_returnflag AS name, count(*) AS votes, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_suppkey, l_returnflag) WHERE r = 1",
    "set_scores": "WITH p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), g AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), n AS (SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM p SEMI JOIN g USING (doc_id)) AS b), r AS (SELECT *, CAST(b AS DOUBLE) / p AS precision, CAST(b AS DOUBLE) / g AS recall FROM n) SELECT CAST(b AS BIGINT) AS true_positives, CAST(p - b AS BIGINT) AS false_positives, CAST(g - b AS BIGINT) AS false_negatives, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM r",
    "audit_outer": f"WITH p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'src-1' ELSE 'Src 2' END AS proposed_label FROM labels), g AS (SELECT doc_id, source AS gold_label FROM documents) SELECT doc_id, proposed_label, gold_label, CASE WHEN proposed_label IS NULL THEN 'FN' WHEN gold_label IS NULL THEN 'FP' ELSE 'TP' END AS status, CASE WHEN proposed_label IS NOT NULL AND gold_label IS NOT NULL THEN CASE WHEN {sql_joined('proposed_label')} = {sql_joined('gold_label')} THEN 'match' ELSE 'mismatch' END END AS refinement FROM p FULL JOIN g USING (doc_id)",
    "over_merge": " UNION ALL ".join(f"SELECT '{w}' AS what, CAST(sum(n - 1) AS BIGINT) AS collapsed FROM (SELECT count(DISTINCT {v}) AS n FROM orders GROUP BY {k})" for w, k, v in (("status", "o_orderpriority", "o_orderstatus"), ("priority", "o_custkey", "o_orderpriority"))),
    "run_statistics": "SELECT 'events' AS target, event_type AS scenario, 'parity' AS metric, CAST(floor(avg(event_id % 2) * 1e9) AS BIGINT) AS mean_e9, CAST(floor(stddev_pop(event_id % 2) * 1e6) AS BIGINT) AS std_e6, count(*) AS runs FROM events GROUP BY event_type",
    "json_answers": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events",
    "archived_terms": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'kept' ELSE 'archived' END AS state, 'Customer ' || c_custkey AS name FROM customer",
    "valid_mappings": f"WITH {_VOC} SELECT entity || '.' || attr AS attribute, canonical FROM mp JOIN attrs ON {_QK('attribute')} = {_QK('(entity || chr(46) || attr)')}",
    "repaired_prefixes": f"""WITH {_VOC}, parts AS (SELECT *, CASE WHEN contains(attribute, '.') THEN split_part(attribute, '.', 1) END AS e, attribute[strpos(attribute, '.') + 1:] AS a FROM mp)
        SELECT CASE WHEN e IS NULL OR e IN (SELECT entity FROM attrs) THEN attribute ELSE coalesce((SELECT arg_min(entity, CASE WHEN attr = a THEN 0 ELSE 1 END * 1000000000000 + epos::BIGINT * 1000000000 + apos) FROM attrs WHERE lower(attr) = lower(a)), e) || '.' || a END AS attribute, canonical FROM parts""",
    "filled_mappings": f"""WITH {_VOC}, ms AS (SELECT * FROM mp WHERE seq % 6 IN (0, 1, 2)), ts AS (SELECT name, pos, CASE WHEN pos % 3 = 0 THEN sources ELSE [] END AS sources FROM tm),
        m AS (SELECT entity || '.' || attr AS attribute, {sql_key('attr')} AS part, replace(attr, '_', ' ') AS name FROM attrs WHERE {_QK('(entity || chr(46) || attr)')} NOT IN (SELECT {_QK('attribute')} FROM ms)),
        said AS (SELECT {sql_key("attribute[strpos(attribute, '.') + 1:]")} AS part, canonical AS name FROM ms UNION ALL SELECT {sql_key("source[strpos(source, '.') + 1:]")}, name FROM (SELECT unnest(sources) AS source, name FROM ts)),
        v AS (SELECT part, name, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, lower(name), name) AS r FROM said GROUP BY part, name),
        n AS (SELECT {sql_key('name')} AS part, arg_min(name, pos) AS name FROM ts GROUP BY 1)
        SELECT attribute, coalesce(v.name, n.name, {_TERM.replace("('name'", "('m.name'").replace("(name,", "(m.name,").replace("regexp_replace(name", "regexp_replace(m.name")}) AS canonical,
               CASE WHEN v.name IS NOT NULL THEN 0.75::DOUBLE WHEN n.name IS NOT NULL THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS confidence, CASE WHEN v.name IS NOT NULL THEN 'votes' WHEN n.name IS NOT NULL THEN 'name' ELSE 'new' END AS source
        FROM m LEFT JOIN (SELECT * FROM v WHERE r = 1) v USING (part) LEFT JOIN n USING (part)""",
    "filled_entities": _rows("source_entity, canonical, confidence", ("AIRPORT", "Airport", 0.74), ("person passengers", "Passenger Person", 0.68), ("crewMember", "Crew Member", 0.58), ("crew_members", "Crew Member", 0.74), ("LOUNGE", "Waiting Room", 0.86)),
    "fresh_sources": f"WITH {_VOC}, k AS (SELECT list({_QK('(entity || chr(46) || attr)')}) AS ks FROM attrs) SELECT name, array_to_string(list_filter(sources, lambda s: list_contains(ks, {_QK('s')})), ',') AS sources FROM tm CROSS JOIN k",
    "merged_terms": f"""WITH {_VOC}, {_NEW_SQL},
        spelled AS (SELECT name, pos, unnest(list_append(synonyms, name)) AS k, unnest(range(1, len(synonyms) + 2)) AS place FROM tm),
        idx AS (SELECT lower(k) AS k, arg_max(name, pos * 1000 + place) AS target FROM spelled GROUP BY 1),
        al AS (SELECT lower(name) AS key, 0 AS side, * FROM tm UNION ALL SELECT coalesce(lower(target), lower(name)), 1, nw.* FROM nw LEFT JOIN idx ON lower(name) = k),
        heads AS (SELECT key, arg_min(name, side * 1000000000 + pos) AS name, arg_max(sources, side * 1000000000 + pos) AS sources, arg_max(description, length(description) * 1000000000000 - side * 1000000000 - pos) AS description FROM al GROUP BY key),
        said AS (SELECT key, side * 1000000000 + pos AS seat, unnest(list_prepend(name, synonyms)) AS s, unnest(range(0, len(synonyms) + 1)) AS place FROM al),
        firsts AS (SELECT key, arg_min(s, seat * 1000 + place) AS s, min(seat * 1000 + place) AS o FROM said WHERE lower(s) <> key GROUP BY key, lower(s))
        SELECT name, description, coalesce((SELECT string_agg(s, ',' ORDER BY o) FROM firsts f WHERE f.key = h.key), '') AS synonyms, array_to_string(sources, ',') AS sources FROM heads h""",
    "remapped": f"WITH {_VOC} SELECT attribute, coalesce((SELECT arg_min(name, pos) FROM tm WHERE lower(name) = lower(canonical)), (SELECT arg_min(name, pos) FROM tm WHERE list_contains(list_transform(synonyms, lambda s: lower(s)), lower(canonical))), canonical) AS canonical FROM mp",
    "new_terms": f"""WITH {_VOC}, ms AS (SELECT attribute, canonical, seq FROM mp),
        syn AS (SELECT lower(k) AS k, arg_max(lower(name), pos) AS name FROM (SELECT name, pos, unnest(synonyms) AS k FROM tm) GROUP BY 1),
        keyed AS (SELECT *, coalesce((SELECT any_value(lower(name)) FROM tm WHERE lower(name) = lower(canonical)), (SELECT name FROM syn WHERE k = lower(canonical)), lower(canonical)) AS key FROM ms),
        every AS (SELECT lower(name) AS key, unnest(sources) AS x, unnest(range(0, len(sources))) AS o FROM tm UNION ALL SELECT key, attribute, 1000000000 + seq FROM keyed),
        firsts AS (SELECT key, x, min(o) AS o FROM every GROUP BY key, x),
        names AS (SELECT lower(name) AS key, name, pos FROM tm UNION ALL SELECT key, arg_min(canonical, seq), (SELECT max(pos) FROM tm) + row_number() OVER (ORDER BY min(seq)) FROM keyed WHERE key NOT IN (SELECT lower(name) FROM tm) GROUP BY key)
        SELECT name, coalesce((SELECT string_agg(x, ',' ORDER BY o) FROM firsts f WHERE f.key = n.key), '') AS sources, CAST(pos AS BIGINT) AS pos FROM names n""",
    "owned_sources": f"""WITH {_VOC}, ms AS (SELECT attribute, canonical, seq FROM mp),
        own AS (SELECT {_QK('attribute')} AS k, arg_max(lower(canonical), seq) AS owner, arg_max(attribute, seq) AS shown, min(seq) AS o FROM ms GROUP BY 1),
        held AS (SELECT pos, lower(name) AS low, unnest(sources) AS x, unnest(range(0, len(sources))) AS o FROM tm),
        every AS (SELECT pos, {_QK('x')} AS k, x, held.o FROM held LEFT JOIN own w ON {_QK('x')} = w.k WHERE w.owner IS NULL OR w.owner = low UNION ALL SELECT pos, k, shown, 1000000000 + o FROM own JOIN tm ON lower(name) = owner),
        firsts AS (SELECT pos, k, arg_min(x, o) AS x, min(o) AS o FROM every GROUP BY pos, k)
        SELECT name, coalesce((SELECT string_agg(x, ',' ORDER BY o) FROM firsts f WHERE f.pos = tm.pos), '') AS sources FROM tm""",
    "short_terms": f"""WITH p AS (SELECT {_SPARE['name']} AS name, p_partkey, {{{{'e': {sql_tokens(_SPARE['entity'])}, 'a': {sql_tokens(_SPARE['attr'])}}}}} AS s FROM part),
        t AS (SELECT name, min(p_partkey) AS pos, {sql_tokens('name')} AS w, list_filter(list(s), lambda x: len(x.a) > 0) AS parts FROM p GROUP BY name),
        n AS (SELECT *, flatten(list_transform(parts, lambda x: CASE WHEN len(list_filter(x.a, lambda y: NOT list_contains(x.e, y))) > 0 THEN list_filter(x.a, lambda y: NOT list_contains(x.e, y)) ELSE x.a END)) AS needed FROM t),
        l AS (SELECT *, coalesce(list_position(list_transform(w, lambda y: len(list_filter(parts, lambda x: NOT list_contains(x.e, y))) = 0 AND NOT list_contains(needed, y)), false) - 1, len(w)) AS lead FROM n),
        r AS (SELECT pos, name, CASE WHEN lead >= 2 AND lead < len(w) THEN w[lead + 1:] ELSE w END AS w FROM l)
        SELECT pos, name, array_to_string(list_transform(w, lambda t: {_CAPITAL.format(t='t')}), ' ') AS short FROM r""".replace("{{", "{").replace("}}", "}"),
    "plain_vocabulary": f"WITH {_VOC} SELECT replace(lower(trim(attr)), ' ', '_') AS name, string_agg(attr, ',' ORDER BY apos) AS synonyms, string_agg(entity || '.' || attr, ',' ORDER BY apos) AS sources, 0.5::DOUBLE AS confidence FROM attrs GROUP BY 1",
    "hybrid_merge": _rows(
        "kind, entity, name, detail, prov", ("attribute", "Booking", "seat", "string", "deterministic"), ("attribute", "Booking", "passport", "string", "deterministic"), ("attribute", "Booking", "mood", "TEXT", "llm"), ("attribute", "Airport", "airport_code", "string", "deterministic"), ("attribute", "Airport 2", "iata", "TEXT", "llm"),
        *[("attribute", "Booking", a, k, "deterministic") for a, k in (("flight_number", "string"), ("flight_date", "datetime"), ("origin_code", "string"))], ("attribute", "Airport", "city", "string", "deterministic"),
        ("relationship", "Booking", "mood", "Airport", "llm"), ("relationship", "Booking", "origin_code", "Airport", "deterministic"), ("key", "Booking", "seat", "", "deterministic"), ("key", "Airport", "airport_code", "", "deterministic"), ("key", "Airport 2", "iata", "", "llm"),
    ),
    "mapping_scores": "SELECT 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 0::BIGINT AS false_positives, 0::BIGINT AS false_negatives, (2 + 8 + 15)::DOUBLE / 11 AS curation_effort, 0.0::DOUBLE AS over_merge_rate, 0.0::DOUBLE AS under_merge_rate, 0.0::DOUBLE AS hallucination_rate, 1.0::DOUBLE AS provenance_completeness, 1.0::DOUBLE AS proposed_provenance_completeness, 4.0::DOUBLE / 9 AS refinement_accuracy, 1.0::DOUBLE AS type_accuracy, 1.0::DOUBLE AS category_accuracy",
    "integration_scores": "SELECT 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 0.0::DOUBLE AS over_merge_rate, 0.0::DOUBLE AS under_merge_rate, 1.0::DOUBLE AS unique_a_coverage, 0.5::DOUBLE AS unique_b_coverage, 3.0::DOUBLE / 4 AS conflict_resolution_accuracy",
}
