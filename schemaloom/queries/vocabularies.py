"""Queries on building and enriching a vocabulary, and on whole models of data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.names import bare_key
from schemaloom.operators import decompose, ontology, sampling, validate
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.model import of_rows
from schemaloom.operators.profile import value_index
from schemaloom.plans.vocabularies import ENTITIES, MAPPINGS, TERMS, Vocabulary, build_vocabulary
from schemaloom.queries.common import FLAT_COLUMNS, FLAT_SQL, RENAMED_COLUMNS, flat, renamed, sql_jaccard, sql_key, sql_tokens, table
from schemaloom.queries.data import _fd_pair
from schemaloom.queries.models import _rows
from schemaloom.queries.names import _SYN


def carried_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of even orders first, then those of the others, numbered on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("attribute"), F.col("o_orderstatus").alias("canonical"), F.col("o_orderkey").alias("seq"))
    old, new = o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1")
    return voc.carried_forward(old, new)


def reified_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names that give way to an attribute's preferred term, and the terms' synonyms after that."""
    hints = spark.createDataFrame([("Flight", "code", "identifier", "Identifier"), ("Flight", "day", "temporal_quality", "Date"), ("Flight", "state", "status_quality", "Status"), ("Seat", "price", "relationship_measure_qualifier", "Price"), ("Seat", "row", "descriptive_quality", "Row")], "entity string, attr string, role string, preferred string")
    rows = [("Flight.code", "Number"), ("flight.Day", "Flight Date"), ("Flight.state", "state"), ("Seat.price", "Paid price now"), ("Seat.row", "ROW"), ("Gate.no", "Number")]
    terms = spark.createDataFrame([("Position", "", ["row"], [], 0), ("Key", "", ["identifier"], [], 1)], "name string, description string, synonyms array<string>, sources array<string>, pos int")
    moved, terms = voc.reify(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "attribute string, canonical string, seq long"), hints, terms)
    return moved.select("attribute", "canonical").union(terms.select("name", F.array_join("synonyms", ",")))


def entity_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the star schema against concepts with known columns."""
    parts = renamed(spark, sf_dir)
    entities = spark.createDataFrame([(n, [c.replace("_", "") for c in df.columns]) for n, df in parts.items()], "entity string, attrs array<string>")
    canon = spark.createDataFrame([(n, list(a)) for n, a in _CANON.items()], "canonical string, attrs array<string>")
    linked = spark.createDataFrame([("Nation",), ("Customer",), ("Orders",)], "entity string")
    return voc.entity_scores(entities, canon, linked)


_CANON = {"Customers": ("customerkey", "city"), "Order Line": ("orderkey", "priority", "customerkey"), "Country": ()}


def attribute_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes against terms: names, values and entities of their members. Values are those of customers, suppliers and orders."""
    parts = renamed(spark, sf_dir)
    attrs = spark.createDataFrame([("Customer", "nation_key", 0, 0), ("Orders", "customer_key", 1, 0), ("Orders", "priority", 1, 1)], "entity string, attr string, epos int, apos int")
    terms = spark.createDataFrame(_TERMS, "name string, synonyms array<string>, sources array<string>, pos int")
    values = {"nationkey": parts["Customer"].select("nation_key"), "customerkey": parts["Orders"].select("customer_key"), "priority": parts["Orders"].select("priority"), "home": parts["Supplier"].select("nation_key"), "who": parts["Customer"].select("customer_key")}
    from schemaloom.operators.integrate import instance_values, value_overlaps

    found = instance_values(values)
    evidence = value_overlaps(found, found).select(F.col("a_source").alias("a"), F.col("b_source").alias("b"), F.col("instance").alias("overlap"))
    kinds = spark.createDataFrame([(v, "text" if v == "priority" else "numeric") for v in values], "part string, kind string")
    return voc.attribute_scores(attrs, terms, evidence, kinds).select("entity", "attr", "name", "syntactic", "instance", "structural")


_TERMS = [("Home Nation", ["home"], ["Supplier.home"], 0), ("Client", [], ["Customer.who", "Orders.priority"], 1), ("Price", [], [], 2), ("Created", [], [], 3), ("Remark", [], [], 4)]
_OVERLAP = "SELECT CAST(s AS DOUBLE) / (x + y - s) FROM (SELECT (SELECT count(DISTINCT {u}) FROM {a}) AS x, (SELECT count(DISTINCT {v}) FROM {b}) AS y, (SELECT count(*) FROM (SELECT CAST({u} AS VARCHAR) FROM {a} INTERSECT SELECT CAST({v} AS VARCHAR) FROM {b})) AS s)"
_VALUES = {"nationkey": ("c_nationkey", "customer"), "customerkey": ("o_custkey", "orders"), "priority": ("lower(o_orderpriority)", "orders"), "home": ("s_nationkey", "supplier"), "who": ("c_custkey", "customer")}


def _attribute_sql() -> str:
    out = []
    for e, a, part, kind in (("Customer", "nation_key", "nationkey", "numeric"), ("Orders", "customer_key", "customerkey", "numeric"), ("Orders", "priority", "priority", "text")):
        for name, synonyms, sources, _ in _TERMS:
            names = [name, *synonyms]
            near = lambda x, y: f"greatest(CASE WHEN {sql_key(x)} = '' OR {sql_key(y)} = '' THEN 0.0 ELSE 1 - CAST(levenshtein({sql_key(x)}, {sql_key(y)}) AS DOUBLE) / greatest(length({sql_key(x)}), length({sql_key(y)})) END, {sql_jaccard(sql_tokens(x), sql_tokens(y))})"
            syn = "greatest(" + ", ".join([near(f"'{a}'", f"'{n}'") for n in names] + ["0.0"]) + ")"
            struct = "greatest(" + ", ".join([near(f"'{e}'", f"'{s.split('.')[0]}'") for s in sources] + ["0.0"]) + ")"
            if sources:
                parts = [s.split(".")[1] for s in sources]
                best = ", ".join("(" + _OVERLAP.format(u=_VALUES[part][0], a=_VALUES[part][1], v=_VALUES[p][0], b=_VALUES[p][1]) + ")" for p in parts)
                same = sum((kind == "text") == (p == "priority") for p in parts)
                inst = f"0.7::DOUBLE * greatest({best}, 0.0) + 0.3::DOUBLE * ({same}::DOUBLE / {len(parts)})"
            else:
                inst = {("numeric", "Price"): "0.8", ("text", "Price"): "0.5", ("text", "Remark"): "0.5"}.get((kind, name), "0.0") + "::DOUBLE"
            out.append(f"SELECT '{e}' AS entity, '{a}' AS attr, '{name}' AS name, CAST({syn} AS DOUBLE) AS syntactic, {inst} AS instance, CAST({struct} AS DOUBLE) AS structural")
    return " UNION ALL ".join(out)


def built_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary from nothing: later attributes reuse the terms that earlier ones made."""
    attributes = of_rows(spark, {"entities": [{"name": "Flight", "attributes": [{"name": "flight_number"}, {"name": "departure"}]}, {"name": "Trip", "attributes": [{"name": "flightNumber"}, {"name": "fare"}]}]}).attributes
    evidence = spark.createDataFrame([("flightnumber", "flightnumber", 1.0)], "a string, b string, overlap double")
    kinds = spark.createDataFrame([("flightnumber", "text"), ("departure", "date"), ("fare", "numeric")], "part string, kind string")
    none = spark.createDataFrame([], "name string, synonyms array<string>, sources array<string>, pos int")
    return voc.build(attributes, none, evidence, kinds).select("attribute", "canonical", "is_new", "seq")


_STAR = {"Region": ("region_key", {}), "Nation": ("nation_key", {"region_key": "Region"}), "Customer": ("customer_key", {"nation_key": "Nation"}), "Supplier": ("supplier_key", {"nation_key": "Nation"}), "Orders": ("order_key", {"customer_key": "Customer"})}


def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the star schema from plain names: the term of each column, what its values mean, and each entity's name."""
    parts = renamed(spark, sf_dir)
    attributes = lambda e: [{"name": c, "data_type": "VARCHAR", "is_primary_key": c == _STAR[e][0], "references": f"{_STAR[e][1][c]}.{c}" if c in _STAR[e][1] else None} for c in RENAMED_COLUMNS[e]]
    erd = of_rows(spark, {"entities": [{"name": e, "primary_key": [_STAR[e][0]], "attributes": attributes(e)} for e in _STAR]})
    out = build_vocabulary(erd, "plain", data=parts)
    shown = F.concat_ws(".", "entity", "attr")
    meaning = out.semantics.select(shown.alias("attribute"), "logical_type")
    columns = out.mappings.join(meaning, "attribute").join(out.terms.select(F.col("name").alias("canonical"), F.array_contains("roles", "identifier").alias("identifies")), "canonical")
    return columns.select(F.lit("column").alias("what"), "attribute", "canonical", "logical_type", "identifies").union(out.entities.select(F.lit("entity"), "source_entity", "canonical", F.lit(None), F.lit(None)))


def matched_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and columns of customers and suppliers matched with a vocabulary made of nations before, by names and values."""
    parts = renamed(spark, sf_dir)
    known = Vocabulary(
        spark.createDataFrame([("Nation Key", None, ["nation"], ["Country.nation_key"], 0), ("Label", None, [], ["Country.nation_name"], 1)], TERMS),
        spark.createDataFrame([("Country.nation_key", "Nation Key", 0.9, "", 0), ("Country.nation_name", "Label", 0.9, "", 1)], MAPPINGS),
        spark.createDataFrame([("Country", "Customers", 0.9, "", 0)], ENTITIES),
    )
    erd = of_rows(spark, {"entities": [{"name": e, "attributes": [{"name": c} for c in RENAMED_COLUMNS[e]]} for e in ("Customer", "Supplier")], "relationships": [{"from_entity": "Customer", "to_entity": "Supplier"}]})
    out = build_vocabulary(erd, "algorithmic", existing=known, data={e: parts[e] for e in ("Customer", "Supplier")})
    return out.mappings.select(F.lit("column").alias("what"), "attribute", "canonical", "rationale").union(out.entities.select(F.lit("entity"), "source_entity", "canonical", "rationale"))


def enriched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of orders and their customers: logical type, domain, unit, currency, confidence in hundredths."""
    o = table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("is_open"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(" kg")).alias("load"), F.floor("o_totalprice").cast("string").alias("price_usd"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_of_order"))
    declared = {"o_orderkey": "BIGINT"}
    erd = of_rows(spark, {"entities": [{"name": "Order", "primary_key": ["o_orderkey"], "attributes": [{"name": c, "data_type": declared.get(c, "VARCHAR"), "is_primary_key": c == "o_orderkey"} for c in df.columns]}]})
    first = sampling.first_values(df, ["o_orderkey"])
    samples = first.groupBy(bare_key("col").alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
    out = voc.enriched(erd.attributes, samples, value_index(df), ontology.unpacking(erd)["attributes"])
    return out.select("attr", "logical_type", "normalization", "semantic_role", F.array_join("domain", ";").alias("domain"), "unit", "currency", F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


def flat_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the flat customer table: columns with types and keys, and relationships."""
    erd, _, _ = decompose.baseline([("flat_customers.csv", flat(spark, sf_dir))])
    a = erd.attributes.select(F.lit("attribute").alias("what"), "entity", F.col("attr").alias("name"), F.concat_ws(" ", "data_type", F.when(F.col("is_pk"), "PK"), F.when(F.col("is_fk"), "FK")).alias("detail"))
    return a.union(erd.relationships.select(F.lit("relationship"), "from_entity", "fk_attribute", F.concat_ws(" ", "to_entity", "from_cardinality", "to_cardinality")))


def normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the flat customer table taken as one entity, and of its parts."""
    df = flat(spark, sf_dir)
    erd = of_rows(spark, {"entities": [{"name": "Flat", "primary_key": ["cust_key"], "attributes": [{"name": c} for c in df.columns]}, {"name": "Nation", "primary_key": ["nation_key"], "attributes": [{"name": "nation_key"}, {"name": "region_key"}]}, {"name": "Pair", "primary_key": ["cust_key", "nation_key"], "attributes": [{"name": "cust_key"}, {"name": "nation_key"}, {"name": "segment"}]}]})
    checks = validate.normal_form_checks({"flat": df}, erd)
    return checks.select("entity", "tbl", "valid", F.explode_outer("issues").alias("issue"))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model against the flat table: one name is wrong, two columns are left out, one edge is wrong."""
    df = flat(spark, sf_dir).select("cust_key", "nation_key", "nation_name", "segment")
    attrs = lambda *xs: [{"name": x} for x in xs]
    link = {"from_entity": "Customer", "to_entity": "Nation", "from_cardinality": "0..N", "to_cardinality": "1", "fk_attribute": "nation_key", "pk_attribute": "nation_key"}
    erd = of_rows(spark, {"entities": [{"name": "Customer", "primary_key": ["cust_key"], "attributes": attrs("Cust_Key", "nation_key", "mood")}, {"name": "Nation", "primary_key": ["nation_key"], "attributes": attrs("nation_key")}], "relationships": [link, {**link, "to_entity": "Shop"}]})
    return validate.validate({"flat": df}, erd).select("true_positives", "false_positives", "false_negatives", "precision", "recall", "relationships", "normal_form")


_names = (carried_mappings, reified_mappings, entity_match_scores, attribute_match_scores, built_vocabulary, build_vocab, matched_vocabulary, enriched_columns, flat_model, normal_form, validation)
QUERIES = {f.__name__: f for f in _names}
_ENTITIES = "e AS (SELECT * FROM (VALUES ('Region', ['regionkey', 'regionname']), ('Nation', ['nationkey', 'nationname', 'regionkey']), ('Customer', ['customerkey', 'customername', 'nationkey', 'segment']), ('Supplier', ['supplierkey', 'suppliername', 'nationkey']), ('Orders', ['orderkey', 'customerkey', 'orderstatus', 'priority'])) t(a, mine))"
_CANON_ROWS = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', [{', '.join(map(repr, a))}]::VARCHAR[])" for n, a in _CANON.items()) + ") t(b, theirs))"
ORACLE = {
    "carried_mappings": "SELECT CAST(o_orderkey AS VARCHAR) AS attribute, o_orderstatus AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders WHERE o_orderkey % 2 = 0) END AS seq FROM orders",
    "reified_mappings": _rows("attribute, canonical", ("Flight.code", "Key"), ("flight.Day", "Date"), ("Flight.state", "state"), ("Seat.price", "Price"), ("Seat.row", "ROW"), ("Gate.no", "Number"), ("Position", "row"), ("Key", "identifier,Number"), ("Date", "Flight Date"), ("Price", "Paid price now")),
    "entity_match_scores": f"WITH {_ENTITIES}, {_CANON_ROWS} SELECT a AS entity, b AS canonical, 0.5::DOUBLE * greatest({_SYN}, {sql_jaccard(sql_tokens('a'), sql_tokens('b'))}) + 0.3::DOUBLE * {sql_jaccard('mine', 'theirs')} + 0.2::DOUBLE * CASE WHEN a IN ('Nation', 'Customer', 'Orders') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM e CROSS JOIN c",
    "attribute_match_scores": _attribute_sql(),
    "built_vocabulary": _rows("attribute, canonical, is_new, seq", ("Flight.flight_number", "Flight Number", True, 0), ("Flight.departure", "Departure", True, 1), ("Trip.flightNumber", "Flight Number", False, 2), ("Trip.fare", "Fare", True, 3)),
    "build_vocab": f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{c}', {c == _STAR[e][0] or c in _STAR[e][1]})" for e in _STAR for c in RENAMED_COLUMNS[e])}) t(entity, attr, is_key)),
        w AS (SELECT *, rtrim(lower(entity), 's') AS own, string_split(attr, '_') AS words FROM c)
        SELECT 'column' AS what, entity || '.' || attr AS attribute,
               CASE WHEN is_key THEN 'Identifier' WHEN len(words) = 1 THEN attr ELSE upper(words[-1][1]) || words[-1][2:] END AS canonical,
               CASE WHEN is_key THEN 'identifier' WHEN words[-1] = 'name' THEN 'text' ELSE 'categorical' END AS logical_type, is_key AS identifies FROM w
        UNION ALL SELECT DISTINCT 'entity', entity, upper(own[1]) || own[2:], NULL, NULL FROM w""",
    "matched_vocabulary": f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{c}')" for e in ("Customer", "Supplier") for c in RENAMED_COLUMNS[e])}) t(entity, attr)),
        w AS (SELECT entity, attr, array_to_string(list_transform(string_split(attr, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM c)
        SELECT 'column' AS what, entity || '.' || attr AS attribute, title AS canonical, CASE WHEN title IN ('Nation Key', 'Label') THEN 'matched' ELSE 'new' END AS rationale FROM w
        UNION ALL SELECT DISTINCT 'entity', entity, CASE WHEN entity || 's' = 'Customers' THEN 'Customers' ELSE entity END, CASE WHEN entity || 's' = 'Customers' THEN 'matched' ELSE 'new' END FROM w""",
    "enriched_columns": _rows(
        "attr, logical_type, normalization, semantic_role, domain, unit, currency, confidence", ("o_orderkey", "identifier", "id_normalized", "identifier", "", None, None, 95), ("o_orderstatus", "categorical", "enum_casefold", "descriptor", "F;O;P", None, None, 92), ("is_open", "boolean", "boolean_cast", "descriptor", "false;true", None, None, 99),
        ("load", "text", "text_trim", "descriptor", "", "kg", None, 77), ("price_usd", "currency", "currency_amount", "measure", "", None, "USD", 95), ("day_of_order", "date", "date_iso", "temporal", "", None, None, 95),
    ).replace("SELECT *", "SELECT * REPLACE (CAST(confidence AS BIGINT) AS confidence)"),
    "flat_model": _rows(
        "what, entity, name, detail", ("attribute", "FlatCustomers", "cust_key", "integer PK"), ("attribute", "FlatCustomers", "segment", "string"), ("attribute", "FlatCustomers", "nation_key", "integer FK"), ("attribute", "FlatCustomers", "region_key", "integer FK"), ("attribute", "Nation", "nation_key", "integer PK"), ("attribute", "Nation", "nation_name", "string"),
        ("attribute", "Region", "region_key", "integer PK"), ("attribute", "Region", "region_name", "string"), ("relationship", "FlatCustomers", "nation_key", "Nation 0..N 1"), ("relationship", "FlatCustomers", "region_key", "Region 0..N 1"),
    ),
    "normal_form": f"""WITH {FLAT_SQL}, rules AS (SELECT * FROM ({' UNION ALL '.join(_fd_pair(x, y) for k in (1, 2, 3) for x in combinations(FLAT_COLUMNS[1:], k) for y in FLAT_COLUMNS[1:] if y not in x)}))
        SELECT 'Flat' AS entity, 'flat' AS tbl, false AS valid, '3nf_violation:' || lhs || '->' || rhs AS issue FROM rules UNION ALL SELECT 'Flat', 'flat', false, 'transitive_dependency:' || lhs || '->' || rhs FROM rules
        UNION ALL SELECT 'Nation', 'flat', false, unnest(['pk_not_unique', '3nf_violation:nation_key->region_key']) UNION ALL SELECT 'Pair', 'flat', false, unnest(['pk_not_minimal:cust_key', 'partial_dependency:cust_key->segment'])""",
    "validation": "SELECT 2::BIGINT AS true_positives, 1::BIGINT AS false_positives, 2::BIGINT AS false_negatives, 2.0::DOUBLE / 3 AS precision, 2.0::DOUBLE / 4 AS recall, 0.5::DOUBLE AS relationships, 0.5::DOUBLE AS normal_form",
}
