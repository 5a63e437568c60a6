"""Queries on names and their similarity, on the names and words of the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import names as N
from schemaloom.functions import similarity as S
from schemaloom.functions import values as V
from schemaloom.queries.common import sql_close, sql_jaccard, sql_joined, sql_key, sql_tokens, table

#: Names of all the shapes that the rules tell apart.
SHAPES = ("customerId", "Order_Lines", "flight-number", "bus stops", "Address", "status", "analysis", "cities", "URL of UUID", "is_active", "hasSeat", "get", "Airline.airline_code", "a.b.c", "PriceUSD", "departureAirportCode", "", "x")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes, and the words of the part names and types."""
    fixed = spark.createDataFrame([(x,) for x in SHAPES], "name string")
    part = table(spark, sf_dir, "part")
    return fixed.union(part.select("p_name")).union(part.select("p_type")).distinct()


_SHAPES = "s AS (SELECT DISTINCT name FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in SHAPES) + "]) AS name UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part))"


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _shapes(spark, sf_dir)
    return df.select("name", N.bare_key("name").alias("bare"), N.trimmed_key("name").alias("trimmed"), N.joined_key("name").alias("joined"), N.spaceless_key("name").alias("spaceless"), N.qualified_key("name").alias("qualified"), N.last_part("name").alias("last"), N.without_prefix("name").alias("verbless"))


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _shapes(spark, sf_dir)
    return df.select("name", F.array_join(N.tokens("name"), " ").alias("tokens"), F.array_join(N.plain_tokens("name"), " ").alias("plain"), N.term(N.tokens("name")).alias("term"), N.entity_label("name").alias("label"))


_CAPITAL = "CASE {t} WHEN 'id' THEN 'ID' WHEN 'pk' THEN 'PK' WHEN 'fk' THEN 'FK' WHEN 'url' THEN 'URL' WHEN 'uuid' THEN 'UUID' ELSE upper({t}[1]) || lower({t}[2:]) END"
_TERM = f"array_to_string(list_transform({sql_tokens('name')}, lambda t: {_CAPITAL.format(t='t')}), ' ')"


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _shapes(spark, sf_dir)
    return df.select("name", N.camel("name").alias("camel"), N.pascal("name").alias("pascal"), N.key_label("name").alias("entity"))


_WORDS = r"list_filter(regexp_split_to_array(trim(name), '[\s_\-]+'), lambda x: x <> '')"


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation against every region and part brand: edit distance, tokens, and what is made of them."""
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("b")).union(table(spark, sf_dir, "part").select("p_type")).distinct()
    c = F.col
    pairs = a.crossJoin(F.broadcast(b))  # names only: 25 by some dozens
    return pairs.select("a", "b", S.syntactic(c("a"), c("b")).alias("syntactic"), S.token_jaccard(c("a"), c("b")).alias("tokens"), S.hybrid(c("a"), c("b")).alias("hybrid"), S.lexical(c("a"), c("b")).alias("lexical"))


_AB = "p AS (SELECT n_name AS a, b FROM nation CROSS JOIN (SELECT r_name AS b FROM region UNION SELECT p_type FROM part))"
_SYN = f"CASE WHEN {sql_key('a')} = '' OR {sql_key('b')} = '' THEN 0.0 ELSE {sql_close(sql_key('a'), sql_key('b'))} END"


def attribute_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and preferred term of attributes in plain and linking entities."""
    rows = table(spark, sf_dir, "part").select(*[F.expr(f"{x} AS {n}") for n, x in _ROLES.items()])
    words, entity = N.tokens("attr"), N.tokens("entity")
    role = N.attribute_role(words, F.col("is_pk"), F.col("is_fk"), F.col("kind"))
    return rows.withColumn("role", role).select("entity", "attr", "role", N.preferred_term(words, entity, F.col("role")).alias("preferred"))


_pick = lambda n, *words: f"element_at(array({', '.join(map(repr, words))}), cast(({n}) % {len(words)} + 1 as int))"
_duck = lambda x: re.sub(r"element_at\(array\((.*?)\), cast\((.*?) as int\)\)", r"([\1])[\2]", x)  # noqa: E731  the same in DuckDB
#: Columns as the parts name them: a word of the part's name and one that says what it is, in entities of several shapes.
_ROLES = {
    "entity": _pick("p_size", "Ring", "Part", "smallBolt", "Widgets"),
    "attr": "concat(split_part(p_name, ' ', 1 + p_partkey % 2), '_', " + _pick("p_partkey", "number", "airline", "code", "time", "status", "type", "seatClass", "price", "row", "date", "total", "remarks", "id") + ")",
    "is_pk": "p_partkey % 7 = 0", "is_fk": "p_size % 5 = 0", "kind": _pick("p_partkey", "entity", "relator", "association", "entity", "entity"),
}
_columns = lambda rules: ", ".join(f"{_duck(x)} AS {n}" for n, x in rules.items())
_ROLE_ROWS = f"r AS (SELECT {_columns(_ROLES)} FROM part)"
_in = lambda words: "len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in words) + "])) > 0"


def distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's order priorities the first spelling of each, with and without regard to case and sign."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("p"))
    firsts = o.groupBy("o_custkey", "p").agg(F.min("o_orderkey").alias("first"))  # some spellings for each customer, however many orders
    lists = firsts.select("o_custkey", F.struct("first", "p").alias("x")).groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]).alias("p"))
    return lists.select("o_custkey", F.array_join(F.array_distinct("p"), ",").alias("exact"), F.array_join(N.distinct_ignoring_case(F.col("p")), ",").alias("caseless"), F.array_join(N.distinct_by(F.col("p"), lambda v: F.substring(v, 1, 1)), ",").alias("by_first"))


_FIRSTS = "(SELECT string_agg(p, ',' ORDER BY o) FROM (SELECT arg_min(p, o) AS p, min(o) AS o FROM x y WHERE y.o_custkey = c.o_custkey GROUP BY {k}))"


def logical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical type, normalisation and role of columns from their names, declared types and shares of values."""
    rows = table(spark, sf_dir, "part").select(*[F.expr(f"{x} AS {n}") for n, x in _LOGICAL.items()])
    c, words = F.col, N.tokens("attr")
    rows = rows.withColumn("logical", V.logical_type(words, c("declared"), c("role"), c("pk"), c("fk"), c("truths"), c("dates"), c("numbers"), c("cat")))
    none = F.array().cast("array<string>")
    return rows.select("attr", "declared", "logical", V.normalization(c("logical"), words, none).alias("normalization"), V.semantic_role(words, c("logical")).alias("semantic_role"))


_share = lambda n: f"cast(({n}) % 21 as double) / 20"
#: Columns of parts with a declared type, a role and shares of values that go over the bounds.
_LOGICAL = {
    "attr": "concat(" + _pick("p_size", "is_", "", "total_", "ticket_", "load_") + ", split_part(p_name, ' ', 1), '_', " + _pick("p_partkey", "passport", "code", "open", "active", "timestamp", "departure", "when", "price", "pct", "seats", "weight", "amount", "status", "role", "remarks", "owner", "date") + ")",
    "declared": _pick("p_partkey * 7 + p_size", "VARCHAR(20)", "INTEGER", "VARCHAR(5)", "TIMESTAMP", "DATE", "DECIMAL", "DOUBLE", "BOOLEAN", "TEXT", "VARCHAR", "CHAR(3)"),
    "role": _pick("p_partkey", "", "", "", "foreign_identifier", "", "", "", "identifier"), "pk": "p_partkey % 11 = 0", "fk": "p_size % 13 = 0",
    "truths": _share("p_partkey * 3"), "dates": _share("p_size"), "numbers": _share("p_partkey + p_size"), "cat": "p_partkey % 3 = 0",
}
_LOGICAL_ROWS = "l AS (SELECT *, " + sql_tokens("attr") + f" AS w, lower(declared) AS d FROM (SELECT {_columns(_LOGICAL)} FROM part))"
_MONEY, _RATIO = _in(N.CURRENCY), _in(("percent", "pct", "ratio"))
_LOGICAL_CASE = f"""CASE WHEN pk OR fk OR role IN ('identifier', 'foreign_identifier') OR {_in(N.IDENTIFIER)} THEN 'identifier'
    WHEN d LIKE '%bool%' OR truths >= 0.9 OR (truths >= 0.6 AND {_in(N.BOOLEAN)}) THEN 'boolean' WHEN {_in(('timestamp', 'datetime'))} OR d LIKE '%timestamp%' OR d LIKE '%datetime%' THEN 'datetime'
    WHEN {_in(N.TEMPORAL)} OR d LIKE '%date%' OR dates >= 0.9 THEN 'date'
    WHEN regexp_matches(d, 'int|float|double|decimal|numeric|number') OR numbers >= 0.9 THEN CASE WHEN {_MONEY} THEN 'currency' WHEN {_RATIO} THEN 'ratio' ELSE 'number' END
    WHEN numbers >= 0.65 AND {_in(N.MEASURE)} THEN CASE WHEN {_MONEY} THEN 'currency' ELSE 'number' END
    WHEN {_in(N.STATUS)} OR {_in(N.CATEGORY)} OR cat THEN 'categorical' ELSE 'text' END"""


def units_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit and currency of columns from their names and first values."""
    rows = table(spark, sf_dir, "part").select(F.expr(f"{_UNITS['attr']} AS attr"), F.array(*[F.expr(x) for x in _SAMPLES]).alias("samples"))
    words = N.tokens("attr")
    return rows.select("attr", V.unit(words, F.col("samples")).alias("unit"), V.currency(words, F.col("samples")).alias("currency"))


_UNITS = {"attr": "concat(split_part(p_name, ' ', 1), " + _pick("p_partkey", "_weight_kg", "_weight", "_share", "_length", "_price_usd", "_price", "_cost", "_currency", "_note") + ")"}
_SAMPLES = ("nullif(concat('about ', p_size), 'about 7')", "concat(p_size, " + _pick("p_partkey * 5 + p_size", " lb", " %", "", " cm", " pieces", " €", " gbp", "EUR") + ")", "concat(" + _pick("p_size", "£ ", "", "$ ") + ", p_partkey % 9, " + _pick("p_partkey", " km", "", " usd", " ms") + ")")
_UNIT_ROWS = "u AS (SELECT *, " + sql_tokens("attr") + f" AS w FROM (SELECT {_columns(_UNITS)}, [{', '.join(map(_duck, _SAMPLES))}] AS samples FROM part))"

QUERIES = {f.__name__: f for f in (normal_forms, name_tokens, name_cases, name_similarity, attribute_roles, distinct_by_key, logical_types, units_currencies)}
_LINKED = "kind IN ('relator', 'association')"
ORACLE = {
    "normal_forms": rf"WITH {_SHAPES} SELECT name, {sql_key('name')} AS bare, lower(trim(name)) AS trimmed, {sql_joined('name')} AS joined, regexp_replace(lower(name), '\s+', '', 'g') AS spaceless, CASE WHEN contains(name, '.') THEN {sql_key('name[1:strpos(name, chr(46)) - 1]')} || '.' || {sql_key('name[strpos(name, chr(46)) + 1:]')} ELSE {sql_key('name')} END AS qualified, string_split(name, '.')[-1] AS last, CASE WHEN regexp_matches(name, '^(is|has|get).') THEN regexp_replace(name, '^(is|has|get)', '') ELSE name END AS verbless FROM s",
    "name_tokens": f"WITH {_SHAPES} SELECT name, array_to_string({sql_tokens('name')}, ' ') AS tokens, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain, {_TERM} AS term, CASE WHEN {_TERM} = '' THEN trim(name) ELSE {_TERM} END AS label FROM s",
    "name_cases": f"""WITH {_SHAPES}, w AS (SELECT name, {_WORDS} AS w FROM s), k AS (SELECT *, regexp_replace(name, '_?(id|key|code|license|ref|no|num|number|pk)$', '', 'i') AS stem FROM w)
        SELECT name, CASE WHEN len(w) = 0 THEN name ELSE lower(w[1]) || array_to_string(list_transform(w[2:], lambda t: upper(t[1]) || lower(t[2:])), '') END AS camel,
        CASE WHEN len(w) = 1 AND regexp_matches(w[1], '^.+\\p{{Lu}}') THEN upper(w[1][1]) || w[1][2:] ELSE array_to_string(list_transform(w, lambda t: upper(t[1]) || lower(t[2:])), '') END AS pascal,
        coalesce(nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(CASE WHEN stem = '' THEN name ELSE stem END, '\\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda t: upper(t[1]) || t[2:]), ''), ''), 'Entity') AS entity FROM k""",
    "name_similarity": f"WITH {_AB} SELECT a, b, {_SYN} AS syntactic, {sql_jaccard(sql_tokens('a'), sql_tokens('b'))} AS tokens, greatest({_SYN}, {sql_jaccard(sql_tokens('a'), sql_tokens('b'))}) AS hybrid, 0.5::DOUBLE * {sql_close(sql_joined('a'), sql_joined('b'))} + 0.5::DOUBLE * {sql_jaccard(sql_tokens('a'), sql_tokens('b'))} AS lexical FROM p",
    "attribute_roles": f"""WITH {_ROLE_ROWS}, t AS (SELECT *, {sql_tokens('attr')} AS w, {sql_tokens('entity')} AS ew FROM r),
        x AS (SELECT *, CASE WHEN is_pk OR {_in(N.IDENTIFIER)} THEN 'identifier' WHEN is_fk THEN 'foreign_identifier' WHEN {_LINKED} AND {_in(N.TEMPORAL)} THEN 'relationship_temporal_qualifier' WHEN {_LINKED} AND {_in(N.MEASURE)} THEN 'relationship_measure_qualifier' WHEN {_LINKED} THEN 'relationship_qualifier'
            WHEN {_in(N.TEMPORAL)} THEN 'temporal_quality' WHEN {_in(N.STATUS)} THEN 'status_quality' WHEN {_in(N.CATEGORY)} THEN 'categorical_quality' WHEN {_in(N.MEASURE)} THEN 'quantitative_quality' ELSE 'descriptive_quality' END AS role,
            list_filter(w, lambda y: NOT list_contains(ew, y)) AS own FROM t)
        SELECT entity, attr, role, CASE WHEN role IN ('identifier', 'foreign_identifier') THEN 'Identifier' WHEN role LIKE '%temporal%' THEN CASE WHEN {_in(('timestamp', 'datetime', 'time'))} THEN 'Timestamp' ELSE 'Date' END WHEN role = 'status_quality' THEN 'Status'
            WHEN role = 'categorical_quality' THEN CASE WHEN list_contains(w, 'type') THEN 'Type' ELSE 'Category' END ELSE array_to_string(list_transform(CASE WHEN len(own) = 0 THEN w ELSE own END, lambda t: {_CAPITAL.format(t='t')}), ' ') END AS preferred FROM x""",
    "distinct_by_key": f"WITH x AS (SELECT o_custkey, o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p FROM orders), c AS (SELECT DISTINCT o_custkey FROM x) SELECT o_custkey, {_FIRSTS.format(k='y.p')} AS exact, {_FIRSTS.format(k='lower(y.p)')} AS caseless, {_FIRSTS.format(k='y.p[1]')} AS by_first FROM c",
    "logical_types": f"""WITH {_LOGICAL_ROWS}, x AS (SELECT *, {_LOGICAL_CASE} AS logical FROM l)
        SELECT attr, declared, logical, CASE logical WHEN 'identifier' THEN 'id_normalized' WHEN 'boolean' THEN 'boolean_cast' WHEN 'date' THEN 'date_iso' WHEN 'datetime' THEN 'datetime_iso' WHEN 'currency' THEN 'currency_amount' WHEN 'number' THEN 'decimal_number' WHEN 'ratio' THEN 'decimal_number' WHEN 'categorical' THEN 'enum_casefold' ELSE CASE WHEN {_in(N.IDENTIFIER)} THEN 'id_normalized' ELSE 'text_trim' END END AS normalization,
        CASE WHEN logical = 'identifier' OR {_in(N.IDENTIFIER)} THEN 'identifier' WHEN logical IN ('date', 'datetime') OR {_in(N.TEMPORAL)} THEN 'temporal' WHEN {_in(N.STATUS)} THEN 'status' WHEN {_in(N.CATEGORY)} THEN 'category' WHEN logical IN ('number', 'currency', 'ratio') OR {_in(N.MEASURE)} THEN 'measure' ELSE 'descriptor' END AS semantic_role FROM x""",
    "units_currencies": f"""WITH {_UNIT_ROWS} SELECT attr,
        coalesce(list_filter(w, lambda t: list_contains([{', '.join(f"'{x}'" for x in N.UNIT)}], t))[1], nullif(list_filter(list_transform(samples, lambda v: lower(regexp_extract(v, '(?i)\\b(kg|g|lb|m|cm|mm|km|ms|s|%)\\b', 1))), lambda v: v <> '')[1], '')) AS unit,
        coalesce(list_filter(list_transform(w, lambda t: upper(t)), lambda t: list_contains([{', '.join(f"'{x}'" for x in V.ISO_CURRENCIES)}], t))[1],
            CASE WHEN NOT list_contains(w, 'currency') THEN list_filter(list_transform(samples, lambda v: CASE {' '.join(f"WHEN contains(v, '{s}') THEN '{iso}'" for s, iso in V.SYMBOLS.items())} {' '.join(f"WHEN contains(upper(v), '{iso}') THEN '{iso}'" for iso in V.ISO_CURRENCIES)} END), lambda v: v IS NOT NULL)[1] END) AS currency FROM u""",
}
