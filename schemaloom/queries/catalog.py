"""Queries on models that the given tables make: each brand is an entity, the names of its parts are its columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import names as N
from schemaloom.operators import hybrid, ontology, scores, validate
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.common import shared_root
from schemaloom.operators.model import Erd, nested
from schemaloom.plans.runs import contract
from schemaloom.queries.common import sql_tokens, table
from schemaloom.queries.names import _CAPITAL, _LINKED, _in
from schemaloom.sources import files

#: The parts' columns as both engines read them: the first word says what a column is (a key's part, a reference), the second what it refers to.
_N = "cast(substr(p_brand, 7) as int)"
_WORD, _THING = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_COLUMN = {
    "entity": f"concat('Brand', {_N})", "epos": _N, "attr": "replace(p_name, ' ', '_')",
    "is_pk": f"{_THING} IN ('ring', 'bolt')", "is_fk": f"{_WORD} IN ('red', 'blue')",
    "ref_entity": f"CASE WHEN {_WORD} IN ('red', 'blue') THEN concat('Brand', ({_N} + length({_THING}) + CASE {_WORD} WHEN 'red' THEN 1 ELSE 0 END) % 25 + 1) END",
    "ref_col": f"CASE WHEN {_WORD} IN ('red', 'blue') THEN concat('small_', {_THING}) END",
}
_TYPE = "CASE max(p_size) % 5 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(9)' WHEN 2 THEN 'DATE' WHEN 3 THEN 'BOOLEAN' ELSE 'DOUBLE' END"
#: Relationships as the suppliers make them, with ends, cardinalities and columns right and wrong.
_RELATION = {
    "rpos": "cast(s_suppkey as int)", "from_entity": "concat('Brand', s_suppkey % 27 + 1)", "to_entity": "concat('Brand', s_nationkey % 26 + 1)",
    "from_cardinality": "CASE s_suppkey % 6 WHEN 0 THEN '0..N' WHEN 1 THEN '1..N' WHEN 2 THEN '1' WHEN 3 THEN 'many' WHEN 4 THEN '0..1' ELSE '0..N' END", "to_cardinality": "CASE s_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0..N' WHEN 2 THEN '0..1' ELSE '1' END",
    "fk_attribute": "CASE s_suppkey % 5 WHEN 0 THEN ' Red_Ring' WHEN 1 THEN 'blue_bolt' WHEN 2 THEN 'small_gear' WHEN 3 THEN '' ELSE 'red_widget' END", "pk_attribute": "CASE s_nationkey % 5 WHEN 0 THEN 'small_ring' WHEN 1 THEN 'SMALL_BOLT ' WHEN 2 THEN 'none' ELSE 'small_widget' END",
}
_expr = lambda rules: ", ".join(f"{x} AS {n}" for n, x in rules.items())


def catalog(spark: SparkSession, sf_dir: str, where: str = "true") -> Erd:
    """The model of the parts for which ``where`` holds, and the suppliers' relationships."""
    keys = [*_COLUMN]
    rows = table(spark, sf_dir, "part").filter(where).selectExpr(*[f"{x} AS {n}" for n, x in _COLUMN.items()], "p_partkey", "p_size").groupBy(*keys).agg(F.min("p_partkey").cast("int").alias("apos"), F.expr(_TYPE).alias("data_type"))
    none = F.lit(None).cast("string")
    attributes = rows.select("entity", "epos", "attr", "apos", "data_type", "is_pk", "is_fk", "ref_entity", "ref_col", F.lit(None).cast("boolean").alias("nullable"), none.alias("prov"))
    key = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("apos", "attr")))), lambda x: x["attr"])
    entities = attributes.groupBy("entity", "epos").agg(key.alias("primary_key")).select("entity", "epos", "primary_key", none.alias("name_prov"), none.alias("pk_prov"))
    relations = table(spark, sf_dir, "supplier").selectExpr(*[f"{x} AS {n}" for n, x in _RELATION.items()]).withColumns({"name": none, "relationship_type": none, "prov": none})
    return Erd(entities, attributes, relations)


def _sql(where: str = "true", suffix: str = "") -> str:
    return f"""ats{suffix} AS (SELECT entity, epos, attr, is_pk, is_fk, ref_entity, ref_col, CAST(min(p_partkey) AS INTEGER) AS apos, {_TYPE} AS data_type FROM (SELECT {_expr(_COLUMN)}, p_partkey, p_size FROM part WHERE {where}) GROUP BY ALL),
    en{suffix} AS (SELECT entity, epos, coalesce(list(attr ORDER BY apos) FILTER (is_pk), []) AS primary_key, count(*) FILTER (NOT is_pk AND NOT is_fk) AS own, count(*) FILTER (is_fk) AS fks, count(DISTINCT ref_entity) FILTER (is_pk AND is_fk) AS linked FROM ats{suffix} GROUP BY entity, epos)"""


_RE = f"re AS (SELECT {_expr(_RELATION)} FROM supplier)"
_CAMEL = "(split_part(attr, '_', 1) || upper(split_part(attr, '_', 2)[1]) || split_part(attr, '_', 2)[2:])"
_ONTOLOGY_OF = lambda where: f"""{_sql(where)}, gr AS (SELECT entity, ref_entity, count(*) AS members, min(apos) AS first FROM ats WHERE is_fk GROUP BY 1, 2),
    co AS (SELECT entity AS concept, epos AS pos, CASE WHEN linked >= 2 THEN 'relator' ELSE 'kind' END AS category, entity AS source FROM en WHERE NOT (linked >= 2 AND own = 0)),
    ab AS (SELECT entity AS concept, entity || '.' || attr AS source, 'property' AS mapping_type, {_CAMEL} AS canonical, CASE WHEN is_pk THEN 'identifier' ELSE 'descriptive' END AS role, NULL AS target, 0 AS x, 0 AS y, apos FROM ats SEMI JOIN co ON entity = concept WHERE NOT is_fk
        UNION ALL SELECT entity, entity || '.' || attr, 'relation_role', CASE WHEN members > 1 THEN {_CAMEL} ELSE 'has' || ref_entity END, NULL, ref_entity, 1, first, apos FROM ats JOIN gr USING (entity, ref_entity) SEMI JOIN co ON entity = concept)"""  # noqa: E731
_ONTOLOGY = _ONTOLOGY_OF("true")


def rule_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' concepts, attributes and relations of the parts' model, as rows."""
    o = ontology.rule_based(catalog(spark, sf_dir))
    a = o["concepts"].select(F.lit("concept").alias("kind"), F.col("concept").alias("name"), "source", F.col("category").alias("detail"))
    b = o["attributes"].select("mapping_type", F.col("canonical"), "source", F.coalesce("role", "target"))
    return a.union(b).union(o["relations"].select(F.lit("relation"), "canonical", "domain", "range"))


def unpacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ontology.unpacking(catalog(spark, sf_dir))
    return u["attributes"].join(u["entities"].select("entity", F.col("kind").alias("entity_kind")), "entity").select("entity", "entity_kind", "attr", "role", "preferred")


def expert_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the rules' ontology: the first concept that has one describes it, all its columns are its sources."""
    rules = ontology.rule_based(catalog(spark, sf_dir))
    return ontology.vocabulary_of(rules["concepts"], rules["attributes"])["terms"].select("name", "description", F.array_join("sources", ",").alias("sources"))


def scaffold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' structure with names that parts propose for columns, in other case and with spaces; the first name wins, unknown columns are left out."""
    rules = ontology.rule_based(catalog(spark, sf_dir))["attributes"]
    named = table(spark, sf_dir, "part").selectExpr(f"{_NAMED} AS source", f"{_PROPOSED} AS canonical", "p_partkey AS pos")
    return ontology.with_scaffold(named, rules).select("source", "canonical", "mapping_type")


_NAMED = f"CASE p_partkey % 3 WHEN 0 THEN concat(upper({_COLUMN['entity']}), '. ', {_COLUMN['attr']}) WHEN 1 THEN concat('None.', {_COLUMN['attr']}) ELSE concat({_COLUMN['entity']}, '.', upper({_COLUMN['attr']})) END"
_PROPOSED = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('name ', p_partkey) END"


def flat_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts and attributes of a flat vocabulary: all kinds and properties. Types of parts are entities, parts of size 9 and more their columns."""
    part = table(spark, sf_dir, "part")
    entities = part.filter("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("source_entity")).agg(F.min("p_name").alias("canonical"))
    out = ontology.concepts_of(entities, part.filter("p_size > 8").selectExpr("concat(p_type, '.', p_partkey) AS attribute", "p_name AS canonical"))
    return out["attributes"].select("concept", "source", "mapping_type", "canonical").union(out["concepts"].select("concept", "source", F.lit("concept"), F.concat_ws(" ", "category", F.col("pos").cast("string"))))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' model and its ontology as texts, for prompts."""
    erd = catalog(spark, sf_dir)
    rules = ontology.rule_based(erd)
    return ontology.erd_text(erd).select(F.lit("erd").alias("what"), "text").union(ontology.ontology_text(rules["concepts"], rules["attributes"], "A").select(F.lit("ontology"), "text"))


def relationship_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' relationships against the parts' model."""
    return validate.relationship_checks(catalog(spark, sf_dir)).select("rpos", "expected_fk_entity", "expected_pk_entity", F.array_join("issues", ",").alias("issues"), "valid")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_counts(validate.relationship_checks(catalog(spark, sf_dir)))


_KEY_ISSUE = "CASE WHEN coalesce({k}_attribute, '') = '' THEN '{k}_attribute_missing' WHEN ({side} = 'from' AND NOT {k}_from AND {k}_to) OR ({side} = 'to' AND NOT {k}_to AND {k}_from) THEN '{k}_on_wrong_entity' WHEN NOT {k}_from AND NOT {k}_to THEN '{k}_attribute_missing' END"
_holds = lambda k, s: f"EXISTS (SELECT 1 FROM ats WHERE ats.entity = {s}_entity AND lower(trim(ats.attr)) = lower(trim({k}_attribute)))"
_CHECKS = f"""{_sql()}, {_RE}, r AS (SELECT *, contains(from_cardinality, 'N') AS mf, contains(to_cardinality, 'N') AS mt, {', '.join(f'{_holds(k, s)} AS {k}_{s}' for k in ('fk', 'pk') for s in ('from', 'to'))} FROM re),
    s AS (SELECT *, CASE WHEN mf <> mt THEN CASE WHEN mf THEN 'from' ELSE 'to' END END AS fs, CASE WHEN mf <> mt THEN CASE WHEN mf THEN 'to' ELSE 'from' END END AS ps FROM r),
    c AS (SELECT rpos, CASE fs WHEN 'from' THEN from_entity WHEN 'to' THEN to_entity END AS expected_fk_entity, CASE ps WHEN 'from' THEN from_entity WHEN 'to' THEN to_entity END AS expected_pk_entity,
        list_filter([CASE WHEN from_entity NOT IN (SELECT entity FROM en) THEN 'from_entity_missing' END, CASE WHEN to_entity NOT IN (SELECT entity FROM en) THEN 'to_entity_missing' END,
            CASE WHEN from_cardinality NOT IN ('1', '0..1', '0..N', '1..N') THEN 'invalid_from_cardinality' END, CASE WHEN to_cardinality NOT IN ('1', '0..1', '0..N', '1..N') THEN 'invalid_to_cardinality' END,
            CASE WHEN mf AND mt THEN 'many_to_many_requires_bridge' END, {_KEY_ISSUE.format(k='fk', side='fs')}, {_KEY_ISSUE.format(k='pk', side='ps')}], lambda x: x IS NOT NULL) AS issues FROM s)"""


def data_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' model as the scenario without proposals takes it."""
    m = hybrid.pure(catalog(spark, sf_dir))
    return m.attributes.select("entity", "attr", "data_type", "prov").join(m.entities.select("entity", "pk_prov"), "entity")


def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' model, written as a JSON document and read again."""
    path = f"{shared_root(spark)}/queries/{uuid.uuid4().hex}"
    erd = catalog(spark, sf_dir)
    nested(Erd(erd.entities, erd.attributes, erd.relationships.limit(0))).select(F.to_json(F.struct("entities", "relationships")).alias("value")).write.text(path)
    return files.erd(spark, path).attributes.select("entity", "attr", "data_type", "is_pk", "is_fk")


def valid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of entities that the parts' model has, spelled as it does, labels in display form: proposals of customers."""
    rows = table(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN concat('brand ', c_nationkey) WHEN 1 THEN concat('BRAND', c_nationkey + 3) ELSE c_mktsegment END AS source_entity", "concat(lower(c_mktsegment), '_ids ', c_custkey) AS canonical")
    return voc.valid_entity_mappings(rows, catalog(spark, sf_dir).entities.select("entity"))


def erd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the even parts against that of parts whose key is no multiple of three."""
    return scores.erd_scores(catalog(spark, sf_dir, "p_partkey % 2 = 0"), catalog(spark, sf_dir, "p_partkey % 3 > 0")).select("pred_entities", "truth_entities", "matched_entities", "entity_precision", "entity_recall", "attribute_coverage", "attribute_placement", "pk_accuracy")


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a proposal made of the even parts, with faults and words around its JSON, violates and leaves out of the model of all parts."""
    o = ontology.rule_based(catalog(spark, sf_dir, "p_partkey % 2 = 0"))
    target = F.when(F.length("canonical") % 4 > 0, F.col("target"))
    maps_to = F.struct(F.col("mapping_type").alias("type"), F.col("canonical").alias("canonical_name"), "role", F.col("canonical").alias("relation"), target.alias("target_concept"))
    source = F.when(F.length("source") % 5 == 0, F.split_part("source", F.lit("."), F.lit(2))).otherwise(F.col("source"))
    attributes = o["attributes"].groupBy("concept").agg(F.collect_list(F.struct(source.alias("source"), maps_to.alias("maps_to"))).alias("attributes"))
    concept = F.struct(F.col("concept").alias("canonical_name"), F.when(F.col("pos") % 5 == 0, "thing").otherwise(F.col("category")).alias("ontological_category"), F.col("source").alias("source_entity"), "attributes")
    doc = o["concepts"].join(attributes, "concept").agg(F.collect_list(concept).alias("concepts")).withColumn("relations", F.array().cast("array<string>"))
    answer = doc.select(F.concat(F.lit("Sure! "), F.to_json(F.struct("concepts", "relations")), F.lit(" Hope this helps.")).alias("answer"))
    return contract(files.proposal(answer, f"concepts {files.CONCEPTS}, relations {files.RELATIONS}").select("doc.*"), catalog(spark, sf_dir))


_WALK = """WITH RECURSIVE {base}, ov AS (SELECT t.epos AS ti, p.epos AS pi, count(*) AS shared FROM atst t JOIN atsp p ON replace(t.attr, '_', '') = replace(p.attr, '_', '') GROUP BY 1, 2),
    pr AS (SELECT ti, pi, shared, CAST(shared AS DOUBLE) / n AS coverage, row_number() OVER (ORDER BY CAST(shared AS DOUBLE) / n DESC, shared DESC, ti DESC, pi DESC) AS i FROM ov JOIN (SELECT epos AS ti, count(*) AS n FROM atst GROUP BY 1) USING (ti)),
    w(i, ls, rs, took) AS (SELECT 0, []::INTEGER[], []::INTEGER[], false UNION ALL SELECT pr.i, CASE WHEN list_contains(ls, ti) OR list_contains(rs, pi) THEN ls ELSE list_append(ls, ti) END, CASE WHEN list_contains(ls, ti) OR list_contains(rs, pi) THEN rs ELSE list_append(rs, pi) END, NOT (list_contains(ls, ti) OR list_contains(rs, pi)) FROM w JOIN pr ON pr.i = w.i + 1),
    m AS (SELECT ti, pi, shared FROM pr JOIN w USING (i) WHERE took AND coverage >= 0.5)"""
QUERIES = {f.__name__: f for f in (rule_ontology, unpacking, expert_vocabulary, scaffold_names, flat_vocabulary, model_texts, relationship_checks, issue_counts, data_model, model_file, valid_entities, erd_scores, contract_issues)}
_LABEL = f"array_to_string(list_transform({sql_tokens('canonical')}, lambda t: {_CAPITAL.format(t='t')}), ' ')"
_KEYED = "array_to_string(list_sort(list_transform(string_split({x}, ','), lambda s: lower(regexp_replace(s, '\\s+', '', 'g')))), ',')"
ORACLE = {
    "rule_ontology": f"""WITH {_ONTOLOGY}, ends AS (SELECT entity, list(ref_entity ORDER BY first, ref_entity) AS t FROM gr SEMI JOIN (SELECT entity FROM en WHERE linked >= 2 AND own = 0) USING (entity) GROUP BY entity)
        SELECT 'concept' AS kind, concept AS name, source, category AS detail FROM co UNION ALL SELECT mapping_type, canonical, source, coalesce(role, target) FROM ab
        UNION ALL SELECT 'relation', 'links' || t[1] || t[2], t[1], t[2] FROM ends WHERE len(t) >= 2""",
    "unpacking": f"""WITH {_sql()}, k AS (SELECT ats.*, {sql_tokens('attr')} AS w, {sql_tokens('entity')} AS ew, CASE WHEN fks >= 2 AND own > 0 THEN 'relator' WHEN fks >= 2 THEN 'association' ELSE 'entity' END AS kind FROM ats JOIN en USING (entity)),
        x AS (SELECT *, CASE WHEN is_pk OR {_in(N.IDENTIFIER)} THEN 'identifier' WHEN is_fk THEN 'foreign_identifier' WHEN {_LINKED} AND {_in(N.TEMPORAL)} THEN 'relationship_temporal_qualifier' WHEN {_LINKED} AND {_in(N.MEASURE)} THEN 'relationship_measure_qualifier' WHEN {_LINKED} THEN 'relationship_qualifier'
            WHEN {_in(N.TEMPORAL)} THEN 'temporal_quality' WHEN {_in(N.STATUS)} THEN 'status_quality' WHEN {_in(N.CATEGORY)} THEN 'categorical_quality' WHEN {_in(N.MEASURE)} THEN 'quantitative_quality' ELSE 'descriptive_quality' END AS role FROM k)
        SELECT entity, kind AS entity_kind, attr, role, CASE WHEN role IN ('identifier', 'foreign_identifier') THEN 'Identifier' ELSE array_to_string(list_transform(w, lambda t: {_CAPITAL.format(t='t')}), ' ') END AS preferred FROM x""",
    "expert_vocabulary": f"""WITH {_ONTOLOGY}, o AS (SELECT ab.*, pos, row_number() OVER (PARTITION BY concept ORDER BY x, y, apos) AS place FROM ab JOIN co USING (concept))
        SELECT canonical AS name, 'Concept: ' || arg_min(concept, pos * 1000000 + place) AS description, string_agg(o.source, ',' ORDER BY pos, place) AS sources FROM o GROUP BY canonical""",
    "scaffold_names": f"""WITH {_ONTOLOGY}, nm AS (SELECT {_KEYED.format(x='source')} AS key, arg_min(canonical, pos) AS name FROM (SELECT {_NAMED} AS source, {_PROPOSED} AS canonical, p_partkey AS pos FROM part) WHERE canonical <> '' GROUP BY 1)
        SELECT source, coalesce(name, canonical) AS canonical, mapping_type FROM ab LEFT JOIN nm ON {_KEYED.format(x='source')} = key""",
    "flat_vocabulary": """WITH e AS (SELECT p_type AS source_entity, min(p_name) AS canonical, row_number() OVER (ORDER BY p_type) - 1 AS pos FROM part WHERE p_type <> 'PROMO' GROUP BY p_type)
        SELECT canonical AS concept, p_type || '.' || p_partkey AS source, 'property' AS mapping_type, p_name AS canonical FROM part JOIN e ON p_type = source_entity WHERE p_size > 8 UNION ALL SELECT canonical, source_entity, 'concept', 'kind ' || pos FROM e""",
    "model_texts": f"""WITH {_ONTOLOGY}, {_RE}, ls AS (SELECT entity, epos, entity || ': ' || string_agg(attr || ' ' || data_type || CASE WHEN is_pk THEN ' PK' ELSE '' END || CASE WHEN is_fk THEN ' FK' || coalesce(' -> ' || ref_entity, '') ELSE '' END, ', ' ORDER BY apos) AS l FROM ats GROUP BY 1, 2),
        rl AS (SELECT rpos, concat_ws(' ', from_entity || ' (' || from_cardinality || ')', '--', to_entity || ' (' || to_cardinality || ')', 'via ' || fk_attribute) AS l FROM re),
        li AS (SELECT concept, string_agg(l, chr(10) ORDER BY l) AS list FROM (SELECT concept, '  - ' || source || ' -> ' || canonical || coalesce(' -> ' || target, '') AS l FROM ab) GROUP BY concept)
        SELECT 'erd' AS what, 'Entities:' || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY epos) FROM ls) || chr(10) || 'Relationships:' || chr(10) || (SELECT string_agg(l, chr(10) ORDER BY rpos) FROM rl) AS text
        UNION ALL SELECT 'ontology', 'Ontology A:' || chr(10) || string_agg(concept || ' (' || category || ') from ' || source || coalesce(chr(10) || list, ''), chr(10) ORDER BY pos) FROM co LEFT JOIN li USING (concept)""",
    "relationship_checks": f"WITH {_CHECKS} SELECT rpos, expected_fk_entity, expected_pk_entity, array_to_string(issues, ',') AS issues, len(issues) = 0 AS valid FROM c",
    "issue_counts": f"WITH {_CHECKS} SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM c) GROUP BY code",
    "data_model": f"WITH {_sql()} SELECT entity, attr, data_type, 'deterministic' AS prov, 'deterministic' AS pk_prov FROM ats",
    "model_file": f"WITH {_sql()} SELECT entity, attr, data_type, is_pk, is_fk FROM ats",
    "valid_entities": f"""WITH {_sql()}, c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'brand ' || c_nationkey WHEN 1 THEN 'BRAND' || (c_nationkey + 3) ELSE c_mktsegment END AS s, lower(c_mktsegment) || '_ids ' || c_custkey AS canonical FROM customer)
        SELECT entity AS source_entity, {_LABEL} AS canonical FROM c JOIN en ON lower(replace(s, ' ', '')) = lower(entity)""",
    "contract_issues": f"""WITH {_ONTOLOGY_OF('p_partkey % 2 = 0')}, {_sql('true', 'x')}, pr AS (SELECT CASE WHEN length(source) % 5 = 0 THEN split_part(source, '.', 2) ELSE source END AS s, mapping_type AS k, CASE WHEN length(canonical) % 4 > 0 THEN target END AS t FROM ab),
        wn AS (SELECT 'entity_missing' AS issue, entity AS item FROM enx WHERE entity NOT IN (SELECT source FROM co) UNION ALL SELECT 'attribute_missing', entity || '.' || attr FROM atsx WHERE entity || '.' || attr NOT IN (SELECT s FROM pr)
            UNION ALL SELECT 'relation_missing', entity || '.' || attr FROM atsx WHERE is_fk AND entity || '.' || attr NOT IN (SELECT s FROM pr WHERE k = 'relation_role')),
        er AS (SELECT 'category' AS issue, concept AS item FROM co WHERE pos % 5 = 0 UNION ALL SELECT 'source', s FROM pr WHERE NOT contains(s, '.') UNION ALL SELECT 'maps_to', s FROM pr WHERE k = 'relation_role' AND t IS NULL)
        SELECT 'error' AS level, issue, item FROM er UNION ALL SELECT 'warning', issue, item FROM wn""",
    "erd_scores": _WALK.format(base=f"{_sql('p_partkey % 2 = 0', 'p')}, {_sql('p_partkey % 3 > 0', 't')}") + """, n AS (SELECT (SELECT count(*) FROM enp) AS p, (SELECT count(*) FROM ent) AS t, (SELECT count(*) FROM m) AS k, (SELECT count(*) FROM atst) AS ta)
        SELECT p AS pred_entities, t AS truth_entities, k AS matched_entities, CAST(k AS DOUBLE) / p AS entity_precision, CAST(k AS DOUBLE) / t AS entity_recall,
            (SELECT CAST(count(*) FILTER (attr IN (SELECT attr FROM atsp)) AS DOUBLE) / count(*) FROM (SELECT DISTINCT attr FROM atst)) AS attribute_coverage, (SELECT coalesce(sum(shared), 0)::DOUBLE FROM m) / ta AS attribute_placement,
            (SELECT CAST(count(*) FILTER (list_sort(a.primary_key) = list_sort(b.primary_key)) AS DOUBLE) / count(*) FROM m JOIN ent a ON a.epos = ti JOIN enp b ON b.epos = pi) AS pk_accuracy FROM n""",
}
