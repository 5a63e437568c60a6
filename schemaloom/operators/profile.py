"""Column profiles: counts, distinct values, inferred types, frequent values, shares of kinds, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from schemaloom.functions.values import DOMAIN, SPREAD, TIMESTAMPS, is_amount, is_date, is_number, is_truth, parses
from schemaloom.operators.common import cells, value_index

#: Shares of values that must hold a digit, a separator, and parse as a time.
DIGITS, SEPARATORS, TIMES = 0.5, 0.5, 0.95
#: Texts of a boolean column.
TRUE_FALSE = ("true", "false", "0", "1", "yes", "no")


def _counted() -> list[Column]:
    return [F.sum("cnt").alias("n"), F.sum(F.when(F.col("value").isNotNull(), 0).otherwise(F.col("cnt"))).alias("nulls"), F.count("value").alias("distinct_cnt")]


def _ratios(found: DataFrame, *more: str) -> DataFrame:
    unique = (F.col("distinct_cnt") == F.col("n")) & (F.col("n") > 0)
    return found.select("col", "pos", *more, "n", "nulls", (F.col("nulls") / F.col("n")).alias("null_ratio"), "distinct_cnt", unique.alias("is_unique"))


def counts(index: DataFrame) -> DataFrame:
    """(col, pos, n, nulls, null_ratio, distinct_cnt, is_unique) of a value index; is_unique: all rows have different values and none is null."""
    return _ratios(index.groupBy("col", "pos").agg(*_counted()))


def profile(df: DataFrame) -> DataFrame:
    """counts() with the inferred type of each column, in one aggregation. A table without rows has a row for each column all the same."""
    schema = df.sparkSession.createDataFrame([(f.name, i) for i, f in enumerate(df.schema)], "col string, pos int")
    judged = value_index(df, digests=True).groupBy("col", "pos").agg(*_counted(), _inferred(_declared(df), F.col("col")).alias("type"))
    return _complete(schema.join(_ratios(judged, "type"), ["col", "pos"], "left"))


def profiles(tables: dict[str, DataFrame], index: DataFrame) -> DataFrame:
    """(tbl, and the columns of profile()) of all tables in one aggregation over their common value index (tbl, col, pos, value, cnt)."""
    label, parted = F.concat_ws("\x1f", "tbl", "col"), "\x1f".join
    known = {parted((t, f.name)): declared_type(f.dataType) for t, df in tables.items() for f in df.schema}
    rows = [(t, f.name, i) for t, df in tables.items() for i, f in enumerate(df.schema)]
    schema = index.sparkSession.createDataFrame(rows, "tbl string, col string, pos int")
    judged = index.groupBy("tbl", "col", "pos").agg(*_counted(), _inferred(known, label).alias("type"))
    return _complete(schema.join(_ratios(judged, "type", "tbl"), ["tbl", "col", "pos"], "left"), "tbl")


def _complete(out: DataFrame, *more: str) -> DataFrame:
    """Columns without any value have counts all the same."""
    zero = F.lit(0).cast("long")
    return out.select("col", "pos", F.coalesce("type", F.lit("string")).alias("type"), F.coalesce("n", zero).alias("n"), F.coalesce("nulls", zero).alias("nulls"), F.coalesce("null_ratio", F.lit(0.0)).alias("null_ratio"), F.coalesce("distinct_cnt", zero).alias("distinct_cnt"), F.coalesce("is_unique", F.lit(False)).alias("is_unique"), *more)


def _declared(df: DataFrame) -> dict[str, str | None]:
    return {f.name: declared_type(f.dataType) for f in df.schema}


def declared_type(kind: T.DataType) -> str | None:
    """The label of a typed column; None for text, whose values decide."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return None


def _inferred(known: dict[str, str | None], name: Column) -> Column:
    """The type of a group of the value index: the declared one (known: by name; None for text), or for text what the values say; texts alone are parsed."""
    fixed = F.create_map(*[F.lit(x) for k, v in known.items() if v for x in (k, v)]) if any(known.values()) else F.create_map().cast("map<string,string>")
    text = name.isin(*[k for k, v in known.items() if not v]) & F.col("value").isNotNull()
    v, low = F.trim("value"), F.lower(F.trim("value"))
    every = lambda test: F.bool_and(F.when(text, test))
    part = lambda test: F.sum(F.when(text & test, F.col("cnt")).otherwise(0)) / F.sum(F.when(text, F.col("cnt")))
    numbers, whole = every(is_number(v)), every(F.coalesce(F.when(is_number(v), F.expr("try_cast(trim(value) as double)") % 1 == 0), F.lit(False)))
    shaped = v.rlike(r"\d") & v.rlike("[-/:.]")  # others can't parse
    times = (part(v.rlike(r"\d")) >= DIGITS) & (part(v.rlike("[-/:.]")) >= SEPARATORS) & (part(F.when(shaped, parses(v, TIMESTAMPS)).otherwise(False)) >= TIMES)
    different = sum((F.max(F.when(text & (low == t), 1).otherwise(0)) for t in TRUE_FALSE), F.lit(0))
    truths = every(low.isin(*TRUE_FALSE)) & (different <= 2)
    judged = F.when(numbers & whole, "integer").when(numbers, "float").when(times, "datetime").when(truths, "boolean").otherwise("string")
    return F.coalesce(F.try_element_at(fixed, name), judged)


def types(df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(col, pos, type): boolean, integer, float, datetime or string.

    Text columns are judged by their values, nulls left out: all numbers (whole ones: integer); or dates, if enough
    values look and parse like one; or at most two different truth values; else string, as with no value at all.
    """
    index = value_index(df) if index is None else index
    return index.groupBy("col", "pos").agg(_inferred(_declared(df), F.col("col")).alias("type"))


def top_values(df: DataFrame, k: int = 3) -> DataFrame:
    """(col, pos, rank, value, cnt): the k most frequent values of each column, ties by value; nulls left out.

    Each column is cut to its top k where the counts are, then across tasks: no task sees all values of a column.
    """
    index = value_index(df).filter(F.col("value").isNotNull())
    order = [F.col("cnt").desc(), F.col("value")]
    some = index.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("col", "part").orderBy(*order))).filter(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(*order))).filter(F.col("rank") <= k).select("col", "pos", "rank", "value", "cnt")


def prompt_statistics(df: DataFrame, k: int = 3) -> DataFrame:
    """(col, pos, dtype, unique_count, null_count, is_unique_candidate, sample_values) for a prompt."""
    tops = top_values(df, k).groupBy("col").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    return counts(value_index(df)).join(tops, "col", "left").select("col", "pos", kinds[F.col("col")].alias("dtype"), F.col("distinct_cnt").alias("unique_count"), F.col("nulls").alias("null_count"), F.col("is_unique").alias("is_unique_candidate"), F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"))


def kind_shares(index: DataFrame) -> DataFrame:
    """(col, pos, n_values, numbers, truths, dates): shares of a column's values of each kind, 0 without values."""
    part = lambda test: F.sum(F.when(test, F.col("cnt")).otherwise(0)) / F.sum("cnt")
    value = F.col("value")
    return index.filter(value.isNotNull()).groupBy("col", "pos").agg(F.sum("cnt").alias("n_values"), part(is_amount(value)).alias("numbers"), part(is_truth(value)).alias("truths"), part(is_date(value)).alias("dates"))


def categories(index: DataFrame) -> DataFrame:
    """(col, pos, is_category, domain): 2 to 12 different values, and few for the rows; the domain in the order of its lower case."""
    key = F.lower(F.trim("value"))
    spelled = index.filter(key != "").groupBy("col", "pos", key.alias("key")).agg(F.min(F.trim("value")).alias("value"), F.sum("cnt").alias("cnt"))
    sized = spelled.groupBy("col", "pos").agg(F.count(F.lit(1)).alias("different"), F.sum("cnt").alias("rows"))
    few = (F.col("different") >= 2) & (F.col("different") <= DOMAIN) & (F.col("different") <= F.greatest(F.lit(2), F.floor(F.col("rows") * SPREAD)))
    sized = sized.withColumn("is_category", few)
    domain = spelled.join(sized.filter("is_category").select("col"), "col", "left_semi").groupBy("col").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda x: x["value"]).alias("domain"))
    return sized.join(domain, "col", "left").select("col", "pos", "is_category", "domain")


def value_kind(index: DataFrame) -> DataFrame:
    """(col, pos, kind): unknown without values, else date, numeric or text as all non-blank values are; only blanks count as date."""
    from schemaloom.functions.values import begins_as_date

    blank = F.trim("value") == ""
    judged = index.groupBy("col", "pos").agg(F.count("value").alias("some"), F.bool_and(F.when(F.col("value").isNotNull() & ~blank, begins_as_date(F.col("value")))).alias("dates"), F.bool_and(F.when(F.col("value").isNotNull() & ~blank, is_amount(F.col("value")))).alias("numbers"))
    return judged.select("col", "pos", F.when(F.col("some") == 0, "unknown").when(F.coalesce("dates", F.lit(True)), "date").when(F.col("numbers"), "numeric").otherwise("text").alias("kind"))
