"""Queries on the rows of tables: profiles, types, samples, keys, dependencies, inclusions, decomposition."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators import decompose, fds, inds, keys, links, sampling
from schemaloom.operators import profile as prof
from schemaloom.queries.common import FLAT_COLUMNS, FLAT_SQL, RENAMED_COLUMNS, RENAMED_SQL, flat, renamed, table

COLUMNS = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [prof.profile(table(spark, sf_dir, t)).withColumn("tbl", F.lit(t)) for t in COLUMNS]
    return parts[0].unionByName(parts[1])


_TYPE = "CASE WHEN any_value(typeof({c})) IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN any_value(typeof({c})) = 'DOUBLE' THEN 'float' WHEN any_value(typeof({c})) LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END"
_PROFILE = "SELECT '{t}' AS tbl, '{c}' AS col, {i} AS pos, " + _TYPE + " AS type, count(*) AS n, count(*) - count({c}) AS nulls, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_ratio, count(DISTINCT {c}) AS distinct_cnt, count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"


def value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct non-null values of the text columns of orders, with their counts."""
    return prof.value_index(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("urgent"))).filter("value is not null").select("col", "value", "cnt")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.top_values(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")).select("col", "rank", "value", "cnt")


def prompt_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prof.prompt_statistics(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return out.select("col", "dtype", "unique_count", "null_count", "is_unique_candidate", F.array_join("sample_values", ";").alias("sample_values"))


_AS_TEXT = {
    "key": ("cast(o_orderkey as string)", "CAST(o_orderkey AS VARCHAR)"),
    "price": ("cast(o_totalprice as decimal(18,2))", "CAST(o_totalprice AS DECIMAL(18,2))"),
    "day": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "status": ("o_orderstatus", "o_orderstatus"),
    "open": ("if(o_orderstatus = 'O', 'yes', 'no')", "CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END"),
    "seat": ("concat(o_custkey % 40, 'D')", "(o_custkey % 40) || 'D'"),
    "bit": ("cast(o_orderkey % 2 as string)", "CAST(o_orderkey % 2 AS VARCHAR)"),
    "none": ("cast(null as string)", "CAST(NULL AS VARCHAR)"),
}


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(*[F.expr(f"cast({s} as string)").alias(c) for c, (s, _) in _AS_TEXT.items()])
    return prof.types(df).select("col", "type")


_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFER = """SELECT '{c}' AS col, CASE WHEN count(v) = 0 THEN 'string'
    WHEN bool_and(regexp_full_match(v, '{num}')) FILTER (v IS NOT NULL) THEN CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) % 1 = 0) FILTER (v IS NOT NULL) THEN 'integer' ELSE 'float' END
    WHEN avg(CAST(regexp_matches(v, '\\d') AS INT)) >= 0.5 AND avg(CAST(regexp_matches(v, '[-/:.]') AS INT)) >= 0.5 AND avg(CAST(try_strptime(v, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%H:%M', '%m/%d/%Y', '%d/%m/%Y']) IS NOT NULL AS INT)) >= 0.95 THEN 'datetime'
    WHEN bool_and(lower(trim(v)) IN ('true', 'false', '0', '1', 'yes', 'no')) FILTER (v IS NOT NULL) AND count(DISTINCT lower(trim(v))) <= 2 THEN 'boolean' ELSE 'string' END AS type
    FROM (SELECT CAST({e} AS VARCHAR) AS v FROM orders)"""


def kind_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of numbers, truth values and dates among JSON and other texts; nulls left out."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    a = events.select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.nullif(F.col("user_id") % 3, F.lit(2)).cast("string").alias("third"))
    b = orders.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return prof.kind_shares(prof.value_index(a)).union(prof.kind_shares(prof.value_index(b))).drop("pos")


_SHARES = """SELECT '{c}' AS col, count(v) AS n_values,
    CAST(count(*) FILTER (regexp_full_match(regexp_replace(replace(trim(v), ',', ''), '^[$€£¥]\\s*', ''), '[+-]?\\d+(\\.\\d+)?')) AS DOUBLE) / count(v) AS numbers,
    CAST(count(*) FILTER (lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 't', 'f')) AS DOUBLE) / count(v) AS truths,
    CAST(count(*) FILTER (try_strptime(trim(v), ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y', '%m-%d-%Y']) IS NOT NULL) AS DOUBLE) / count(v) AS dates
    FROM (SELECT {e} AS v FROM {t})"""


def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").cast("string").alias("key"), "o_orderpriority", F.lit(None).cast("string").alias("none"))
    return prof.value_kind(prof.value_index(df)).select("col", "kind")


def categorical_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    return prof.categories(prof.value_index(df)).select("col", "is_category", F.coalesce(F.array_join("domain", ";"), F.lit("")).alias("domain"))


_CATEGORY = """SELECT '{c}' AS col, n BETWEEN 2 AND 12 AND n <= greatest(2, floor(r * 0.4)) AS is_category, CASE WHEN n BETWEEN 2 AND 12 AND n <= greatest(2, floor(r * 0.4)) THEN d ELSE '' END AS domain
    FROM (SELECT count(DISTINCT lower(trim({c}))) AS n, count(*) AS r, array_to_string(list_sort(list_distinct(list(trim({c})))), ';') AS d FROM (SELECT CAST({c} AS VARCHAR) AS {c} FROM orders))"""


_PAIRS = {"conversations": [("conv_id",), ("turn",), ("conv_id", "turn"), ("conv_id", "role")], "lineitem": [("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey")]}
_NULL = {"conversations": ("turn", "nullif(turn, 3)"), "lineitem": ("l_linenumber", "nullif(l_linenumber, 7)")}


def key_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness of column combinations, one column of each table with nulls."""
    out = None
    for t, combos in _PAIRS.items():
        name, expression = _NULL[t]
        part = keys.key_tests(table(spark, sf_dir, t).withColumn(name, F.expr(expression)), combos).select(F.lit(t).alias("tbl"), F.array_join("key_cols", "+").alias("key_cols"), "n", "full_rows", "full_groups", "is_strict", "is_lenient")
        out = part if out is None else out.unionByName(part)
    return out


def _key_sql(t: str, combo: tuple[str, ...]) -> str:
    name, expression = _NULL[t]
    full = " AND ".join(f"{c} IS NOT NULL" for c in combo)
    row = f"({', '.join(combo)})" if len(combo) > 1 else combo[0]
    return f"""SELECT '{t}' AS tbl, '{'+'.join(combo)}' AS key_cols, count(*) AS n, count(*) FILTER ({full}) AS full_rows, count(DISTINCT CASE WHEN {full} THEN {row} END) AS full_groups,
        count(*) > 0 AND count(*) FILTER ({full}) = count(*) AND count(DISTINCT CASE WHEN {full} THEN {row} END) = count(*) AS is_strict,
        count(*) FILTER ({full}) > 0 AND count(DISTINCT CASE WHEN {full} THEN {row} END) = count(*) FILTER ({full}) AS is_lenient
        FROM (SELECT * REPLACE ({expression} AS {name}) FROM {t})"""


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal keys of one and two of the conversations' columns."""
    df = table(spark, sf_dir, "conversations").select(*_CONV)
    return keys.as_frame(df, "conversations", keys.candidate_keys(df)).select("tbl", F.array_join("key_cols", "+").alias("key_cols"), "size")


_CONV = ("conv_id", "turn", "role", "text")
_CANDIDATES = " UNION ALL ".join(f"SELECT 'conversations' AS tbl, '{'+'.join(c)}' AS key_cols, {len(c)} AS size FROM conversations HAVING count(DISTINCT ({', '.join(c)},)) = count(*)" + (f" AND NOT (SELECT {' OR '.join(f'count(DISTINCT {x}) = count(*)' for x in c)} FROM conversations)" if len(c) > 1 else "") for k in (1, 2) for c in combinations(_CONV, k)).replace(",,", ",").replace(",)", ")")


def pk_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, df in renamed(spark, sf_dir).items():
        part = keys.as_frame(df, name, keys.candidate_keys(df))
        out = part if out is None else out.unionByName(part)
    return keys.primary_keys(out).select("tbl", F.get("key_cols", F.lit(0)).alias("pk"))


_UNIQUES = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, {i} AS pos, count(DISTINCT {c}) = count(*) AS u FROM {t.lower()}_" for t, cols in RENAMED_COLUMNS.items() for i, c in enumerate(cols))


def fd_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and support of single-column dependencies; a key and a dependent column with nulls."""
    df = flat(spark, sf_dir).withColumns({"region_key": F.nullif("region_key", F.lit(2)), "nation_name": F.when(F.col("cust_key") % 5 != 0, F.col("nation_name"))})
    out = fds.strengths(df, [["nation_key"], ["region_key"], ["segment"]], ["nation_name", "region_name", "cust_key"])
    return out.select(F.get("lhs", F.lit(0)).alias("lhs"), "rhs", "strength", "support_ratio", "row_count")


_FD = """SELECT '{x}' AS lhs, '{y}' AS rhs, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS strength, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM f) AS support_ratio, (SELECT count(*) FROM f) AS row_count
    FROM (SELECT {x}, count(*) AS n, count(DISTINCT {y}) + max(CASE WHEN {y} IS NULL THEN 1 ELSE 0 END) <= 1 AS ok FROM f WHERE {x} IS NOT NULL GROUP BY {x})"""
_FD_INPUT = "f AS (SELECT * REPLACE (nullif(region_key, 2) AS region_key, CASE WHEN cust_key % 5 <> 0 THEN nation_name END AS nation_name) FROM flat)"


def fd_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies with left sides of one to three columns."""
    out = fds.discover(flat(spark, sf_dir))
    return out.select(F.array_join("lhs", "+").alias("lhs"), "rhs", "strength", "support_ratio", "row_count")


def _fd_pair(x: tuple[str, ...], y: str) -> str:
    return f"SELECT '{'+'.join(x)}' AS lhs, '{y}' AS rhs, 1.0::DOUBLE AS strength, 1.0::DOUBLE AS support_ratio, count(*) AS row_count FROM flat HAVING count(*) >= 12 AND count(DISTINCT ({', '.join(x)})) = count(DISTINCT ({', '.join((*x, y))})) AND count(DISTINCT ({', '.join(x)})) <= 0.9 * count(*)"


def determines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fds.determines(flat(spark, sf_dir), "nation_name", ["nation_key", "region_name", "segment", "cust_key"])


def inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every pair of columns of different tables that share a value."""
    return inds.inclusions(renamed(spark, sf_dir)).select("child_tbl", "child_col", "parent_tbl", "parent_col", "shared", "child_distinct", "coverage")


_PAIR = """SELECT '{a}' AS child_tbl, '{x}' AS child_col, '{b}' AS parent_tbl, '{y}' AS parent_col, s AS shared, d AS child_distinct, CAST(s AS DOUBLE) / d AS coverage
    FROM (SELECT (SELECT count(*) FROM (SELECT CAST({x} AS VARCHAR) FROM {a}_ INTERSECT SELECT CAST({y} AS VARCHAR) FROM {b}_)) AS s, (SELECT count(DISTINCT {x}) FROM {a}_) AS d) WHERE s > 0"""


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of the renamed star schema with their cardinalities."""
    return _edges(spark, renamed(spark, sf_dir))


def _edges(spark: SparkSession, parts: dict[str, DataFrame]) -> DataFrame:
    """By sketches first; only columns of pairs that these don't refute are compared by value."""
    return links.links(parts).drop("from_pos", "fk_pos")


_FKS = {("Nation", "region_key"): ("Region", "region_key"), ("Customer", "nation_key"): ("Nation", "nation_key"), ("Supplier", "nation_key"): ("Nation", "nation_key"), ("Orders", "customer_key"): ("Customer", "customer_key")}
_EDGE = """SELECT '{a}' AS from_entity, '{b}' AS to_entity, CASE WHEN (SELECT count(DISTINCT {x}) = count(*) FROM {a}_) THEN '0..1' ELSE '0..N' END AS from_cardinality,
    CASE WHEN (SELECT count({x}) = count(*) FROM {a}_) THEN '1' ELSE '0..1' END AS to_cardinality, '{x}' AS fk_attribute, '{y}' AS pk_attribute
    WHERE NOT EXISTS (SELECT {x} FROM {a}_ WHERE {x} IS NOT NULL EXCEPT SELECT {y} FROM {b}_) AND (SELECT count(DISTINCT {y}) = count(*) AND count(DISTINCT {y}) >= 2 FROM {b}_)"""


def junction_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose key is two foreign keys: part and supplier pairs of line items, against the orders."""
    edges = spark.createDataFrame([("PartSupplier", "part_key"), ("PartSupplier", "supplier_key"), ("Order", "customer_key")], "from_entity string, fk_attribute string")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key")).distinct()
    found = keys.as_frame(pairs, "PartSupplier", keys.candidate_keys(pairs)).unionByName(keys.as_frame(pairs, "Order", [("order_key",)]))
    return inds.junctions(edges, keys.primary_keys(found)).select("tbl")


def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-like columns of a wide table, named as the parts are, with the columns that share their stem."""
    columns = table(spark, sf_dir, "part").groupBy(F.expr(_NAME).alias("col")).agg(F.min("p_partkey").cast("int").alias("pos"))
    return decompose.name_groups(columns).select("key", "stem_size", F.array_join("members", ",").alias("members"))


_NAME = "concat(replace(p_name, ' ', '_'), CASE p_partkey % 7 WHEN 0 THEN '_code' WHEN 1 THEN '_name' WHEN 2 THEN '_license' WHEN 3 THEN '_desk' WHEN 4 THEN '' WHEN 5 THEN '_shelf_no' ELSE '_shelf_date' END)"
_NAME_ROWS = f"cols AS (SELECT {_NAME} AS col, min(p_partkey) AS pos FROM part GROUP BY 1)"


def split_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of the flat table when nation and region are split off."""
    parts, _, _ = decompose.split([("customers", flat(spark, sf_dir))])
    return parts["Customers"]


def split_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that are split off the flat table, as rows of text."""
    parts, chosen, _ = decompose.split([("customers", flat(spark, sf_dir))])
    out = None
    for name, key in chosen.items():
        part = parts[name].select(F.lit(name).alias("entity"), F.lit(key[0]).alias("pk"), F.concat_ws("|", *[F.col(c).cast("string") for c in parts[name].columns]).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def role_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in two roles, of customers and of suppliers; the first row of a nation wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("home"), F.col("c_name").alias("home_who"), F.lit(None).cast("int").alias("base"), F.lit(None).cast("string").alias("base_who"), F.col("c_custkey").alias("row"))
    s = table(spark, sf_dir, "supplier").select(F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("s_nationkey"), F.col("s_name"), F.col("s_suppkey"))
    both = c.union(s)
    out = sampling.role_union(both, [{"nation": "home", "who": "home_who"}, {"nation": "base", "who": "base_who"}], ["nation"], ["row", "home_who", "base_who"])
    return out.filter("nation is not null")


_ORDER = ("o_orderkey", "o_custkey", "o_orderstatus")


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last five orders, and ten of the others by hash."""
    return sampling.head_middle_tail(table(spark, sf_dir, "orders").select(*_ORDER), ["o_orderkey"])


def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the first forty events, column by column."""
    return sampling.first_values(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"]).select("col", "rank", "value")


def entity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.entity_values(table(spark, sf_dir, "nation"))


def all_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a value in both columns go, then rows with a null in the first."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return df.na.drop(how="all", subset=["status", "priority"]).agg(F.count(F.lit(1)).alias("some"), F.count("status").alias("with_status"))


def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred orders by hash."""
    return sampling.sample(table(spark, sf_dir, "orders").select(*_ORDER), 500)


_MD5 = "md5(concat_ws('|', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE '+' || {c} END" for c in _ORDER) + "))"


def entity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the columns that are named like an attribute, whatever the case and signs of the name."""
    return sampling.values_of(table(spark, sf_dir, "nation").withColumnRenamed("n_name", "Nation Name"), "nation_name")


def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table cut to the columns that a list of names means, in the list's order; names without a column are left out."""
    df = table(spark, sf_dir, "region")
    found, missing = sampling.aligned(df, [" R_NAME", "r_regionkey ", "r_other"])
    return df.select(*found, F.lit(",".join(missing)).alias("missing"))


def reciprocal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their accounts, one each, whose keys include each other: one of the two edges stays."""
    c = table(spark, sf_dir, "customer")
    parts = {"Customer": c.select(F.col("c_custkey").alias("customer_key"), "c_name"), "Account": c.select(F.col("c_custkey").alias("customer_key"), "c_acctbal")}
    return _edges(spark, parts)


_WITH = f"WITH {RENAMED_SQL} "
_FLAT = f"WITH {FLAT_SQL} "
QUERIES = {f.__name__: f for f in (profile_columns, value_sets, top_values, prompt_statistics, infer_types, kind_shares, value_kinds, categorical_domain, key_tests, candidate_keys, pk_election, fd_strength, fd_discovery, determines, inclusions, fk_edges, junction_detect, name_groups, split_base, split_sub, role_union, head_tail, first_values, entity_values, all_null_rows, sampled_rows, entity_cells, aligned_columns, reciprocal_edges)}
ORACLE = {
    "profile_columns": " UNION ALL ".join(_PROFILE.format(t=t, c=c, i=i) for t, cols in COLUMNS.items() for i, c in enumerate(cols)),
    "value_sets": "SELECT 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS cnt FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'urgent', o_orderpriority, count(*) FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2",
    "top_values": " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(r AS INTEGER) AS rank, v AS value, n AS cnt FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r FROM orders GROUP BY 1) WHERE r <= 3" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")),
    "prompt_statistics": " UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS dtype, count(*) AS unique_count, 0::BIGINT AS null_count, count(*) = sum(n) AS is_unique_candidate, string_agg(v, ';' ORDER BY n DESC, v) FILTER (r <= 3) AS sample_values FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r FROM orders GROUP BY 1)" for c, k in (("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))),
    "infer_types": " UNION ALL ".join(_INFER.format(c=c, e=e, num=_NUM) for c, (_, e) in _AS_TEXT.items()),
    "kind_shares": " UNION ALL ".join(_SHARES.format(c=c, e=e, t=t) for c, e, t in (("k", "json_extract_string(props, '$.k')", "events"), ("event_type", "event_type", "events"), ("third", "CAST(nullif(user_id % 3, 2) AS VARCHAR)", "events"), ("day", "strftime(o_orderdate, '%d/%m/%Y')", "orders"))),
    "value_kinds": " UNION ALL ".join(f"SELECT '{c}' AS col, CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(regexp_matches(v, '^(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}|\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}})')) THEN 'date' WHEN bool_and(regexp_full_match(v, '[+-]?\\d+(\\.\\d+)?')) THEN 'numeric' ELSE 'text' END AS kind FROM (SELECT {e} AS v FROM orders)" for c, e in (("day", "strftime(o_orderdate, '%Y-%m-%d')"), ("key", "CAST(o_orderkey AS VARCHAR)"), ("o_orderpriority", "o_orderpriority"), ("none", "CAST(NULL AS VARCHAR)"))),
    "categorical_domain": " UNION ALL ".join(_CATEGORY.format(c=c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "key_tests": " UNION ALL ".join(_key_sql(t, c) for t, combos in _PAIRS.items() for c in combos),
    "pk_election": _WITH + f"SELECT tbl, col AS pk FROM (SELECT tbl, col, row_number() OVER (PARTITION BY tbl ORDER BY regexp_matches(col, '(?i)(^id$|_id$|_key$|^key$|_code$|^code$)') DESC, pos) AS r FROM ({_UNIQUES}) WHERE u) WHERE r = 1",
    "fd_strength": f"WITH {FLAT_SQL}, {_FD_INPUT} " + " UNION ALL ".join(_FD.format(x=x, y=y) for x in ("nation_key", "region_key", "segment") for y in ("nation_name", "region_name", "cust_key")),
    "fd_discovery": _FLAT + " UNION ALL ".join(_fd_pair(x, y) for k in (1, 2, 3) for x in combinations(FLAT_COLUMNS, k) for y in FLAT_COLUMNS if y not in x),
    "determines": _FLAT + " UNION ALL ".join(f"SELECT 'nation_name' AS key, '{c}' AS col, max(n) <= 1 AS holds FROM (SELECT count(DISTINCT {c}) AS n FROM flat GROUP BY nation_name)" for c in ("nation_key", "region_name", "segment", "cust_key")),
    "inclusions": _WITH + " UNION ALL ".join(_PAIR.format(a=a, b=b, x=x, y=y) for a, xs in RENAMED_COLUMNS.items() for x in xs for b, ys in RENAMED_COLUMNS.items() if a != b for y in ys),
    "fk_edges": _WITH + " UNION ALL ".join(_EDGE.format(a=a, x=x, b=b, y=y) for (a, x), (b, y) in _FKS.items()),
    "junction_detect": "SELECT 'PartSupplier' AS tbl FROM (SELECT count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem) WHERE p < n AND s < n",
    "name_groups": f"""WITH {_NAME_ROWS}, t AS (SELECT col, pos, list_filter(string_split(col, '_'), lambda x: x <> '') AS w FROM cols),
        k AS (SELECT col AS key, list_slice(w, 1, len(w) - 1) AS stem FROM t WHERE len(w) >= 2 AND w[-1] IN ('code', 'id', 'key', 'license', 'ref', 'no', 'number', 'num', 'pk'))
        SELECT key, CAST(len(stem) AS INTEGER) AS stem_size, key || ',' || string_agg(col, ',' ORDER BY pos) AS members FROM k JOIN t ON list_slice(w, 1, len(stem)) = stem AND col <> key GROUP BY key, stem""",
    "split_base": _FLAT + "SELECT cust_key, segment, nation_key, region_key FROM flat",
    "split_sub": _FLAT + "SELECT DISTINCT 'Nation' AS entity, 'nation_key' AS pk, nation_key || '|' || nation_name AS cells FROM flat UNION ALL SELECT DISTINCT 'Region', 'region_key', region_key || '|' || region_name FROM flat",
    "role_union": "SELECT nation, who FROM (SELECT nation, who, row_number() OVER (PARTITION BY nation ORDER BY role, k) AS r FROM (SELECT 0 AS role, c_nationkey AS nation, c_name AS who, c_custkey AS k FROM customer UNION ALL SELECT 1, s_nationkey, s_name, s_suppkey FROM supplier)) WHERE r = 1",
    "head_tail": f"WITH p AS (SELECT {', '.join(_ORDER)}, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS z FROM orders), m AS (SELECT *, row_number() OVER (ORDER BY a <= 5 OR z <= 5, {_MD5}) AS r FROM p) SELECT {', '.join(_ORDER)} FROM m WHERE a <= 5 OR z <= 5 OR r <= 10",
    "first_values": "WITH f AS (SELECT *, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS rank FROM events ORDER BY event_id LIMIT 40) SELECT 'event_id' AS col, rank, CAST(event_id AS VARCHAR) AS value FROM f UNION ALL SELECT 'user_id', rank, CAST(user_id AS VARCHAR) FROM f UNION ALL SELECT 'event_type', rank, event_type FROM f",
    "entity_values": "SELECT DISTINCT lower(trim(v)) AS value FROM (SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation) WHERE trim(v) <> ''",
    "all_null_rows": "SELECT count(*) AS some, count(*) FILTER (o_orderstatus <> 'F') AS with_status FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'",
    "sampled_rows": f"SELECT {', '.join(_ORDER)} FROM orders ORDER BY {_MD5} LIMIT 500",
    "entity_cells": "SELECT n_name AS value FROM nation",
    "aligned_columns": "SELECT r_name, r_regionkey, 'r_other' AS missing FROM region",
    "reciprocal_edges": "SELECT 'Account' AS from_entity, 'Customer' AS to_entity, '0..1' AS from_cardinality, '1' AS to_cardinality, 'customer_key' AS fk_attribute, 'customer_key' AS pk_attribute FROM customer HAVING count(*) >= 2",
    "candidate_keys": _CANDIDATES,
}
