"""Importance resampling towards a target distribution of hashed n-grams.

Documents and target texts become arrays of n-grams, each n-gram a bucket (CRC-32 modulo the number of buckets). Grouped
counts of the buckets on both sides give a table of gains, the log ratio of a bucket's share in the target to its share in
the documents; a document's weight is the sum of its n-grams' gains, found by a join to that table, which has one row for
each bucket and so is broadcast at any input size. Gumbel noise from a hash of the id is added to the weight, which makes
the highest scores a sample without replacement. Scores are sorted in ranges; a document's rank is its place in its range
and the number of rows in the ranges before. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.llm._common import attach, every, fresh, table, whole_text, written
from schemaloom.llm.line_dedup import LOWER, UPPER

#: Longest n-gram, number of buckets, the noise's seed; words from which a document can be drawn, and the percent drawn.
NGRAMS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
#: Fixed value: what parts words once A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fractions of a gain and of a score that are kept.
UNIT = 1000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def ngrams_of(words: Column, ngrams: int) -> Column:
    """All runs of 1 to ``ngrams`` consecutive words, joined by one space."""
    runs = lambda k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, *[runs(k) for k in range(2, ngrams + 1)]) if ngrams > 1 else words


def _featured(rows: DataFrame, ngrams: int, buckets: int, *columns: str) -> DataFrame:
    """columns, n_words and buckets (int array, one for each n-gram) of rows (columns, text)."""
    words = F.get(F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.size(w).alias("n"), ngrams_of(w, ngrams).alias("grams"))), 0)  # the words are bound, so that they are split once
    parts = rows.select(*columns, words.alias("w"))
    return parts.select(*columns, F.col("w.n").alias("n_words"), F.transform("w.grams", lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(buckets)).cast("int")).alias("buckets"))


def _counts(featured: DataFrame, name: str) -> DataFrame:
    """(bucket, count) over all n-grams; a row for each bucket that occurs."""
    return featured.select(F.explode_outer("buckets").alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, s) of the documents and (bucket, t) of the target, in units of 1/UNIT and rounded down."""
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(documents, "bucket", "left").join(target, "bucket", "left")
    both = written(both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "buckets", narrow=True)
    s_all, t_all = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(s_all + buckets) / ((F.col("s") + 1) * F.lit(t_all + buckets))
    return both.select("bucket", F.floor(UNIT * F.log(ratio)).alias("gain"))


def _noise(id_: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written, with ``rank`` (1, 2, ...) in a total order, nowhere sorted in one task: ranges are sorted each for itself and begin after all rows of those before them."""
    part, at, before, n = (fresh(c, rows) for c in ("part", "at", "before", "n"))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    placed = written(sorted_.withColumn(at, number).withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    offsets = sizes.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # a row for each range
    return placed.join(F.broadcast(offsets), part, "left").select(*every(rows), (F.col(before) + F.col(at) + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_features, weight, score, rank (longs; rank is null where it isn't drawn).

    Of the N rows with ``least`` words or more the N * percent // 100 highest scores are drawn; ties go to the smaller doc_id
    (any type with an order), a null id after all others. target needs text. A null text has no words and the weight 0; a
    null id's noise is that of an empty one. Rows that repeat an id are documents of their own with the same noise; the order
    among rows that repeat the text too is free, as nothing tells them apart. Empty documents give an empty result, an empty
    target counts 0 in each bucket. Other columns are not looked at. A very long text is split where it lies; its n-grams are
    summed up before they are shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    featured = written(_featured(rows, ngrams, buckets, "row", "doc_id"), "features")  # rows are numbered once and for all here
    wanted = _featured(target.select(whole_text().alias("text")), ngrams, buckets)
    table_ = written(gains(_counts(featured, "s"), _counts(wanted, "t"), buckets), "gains", narrow=True)
    each = featured.select("row", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(table_), "bucket", "left")
    sums = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = written(sums.withColumn("score", (F.col("weight") + _noise(F.col("doc_id"), seed)).cast("long")), "scored")
    some = scored.filter(F.col("n_words") >= least)
    drawn = some.count() * percent // 100
    placed = ranked(some, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of docs whose id is drawn, all columns as they are; of rows that repeat an id all stay if one is drawn."""
    id_ = fresh("id", docs)
    some = resampled(docs.select("doc_id", "text"), target, **how).filter("rank is not null").select(F.struct("doc_id").alias(id_)).distinct()
    return attach(docs.withColumn(id_, F.struct("doc_id")), written(some, "drawn", narrow=True), [id_], "left_semi").select(*every(docs))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_features(name: str, key: str) -> str:
    return f"""
        SELECT {key}, unnest(w) AS word FROM (
            SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w FROM {name})"""


_ROUND = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
#: CRC-32 by its definition: eight shifts for each byte of a word.
_STEP = "list_reduce(range(8), lambda r, k: " + _ROUND.format("r") + ", xor(c, b))"

QUERIES = {"op12_importance": op12_importance}
ORACLE = {
    "op12_importance": f"""
        WITH d AS ({_sql_features('documents', 'doc_id')}), b AS ({_sql_features('benchmark', 'item_id')}),
        words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION ALL SELECT word FROM b)),
        bytes AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS v FROM words),
        hashed AS (SELECT word, xor(list_reduce(v, lambda c, b: {_STEP}, CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket FROM bytes),
        s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
        sums AS (SELECT (SELECT count(*) FROM d) AS s_all, (SELECT count(*) FROM b) AS t_all),
        gain AS (SELECT bucket, CAST(floor({UNIT} * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * (t_all::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
                 FROM s LEFT JOIN t USING (bucket), sums),
        weighed AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM d JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                          CAST(coalesce(weight, 0) + floor(-{UNIT} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
                   FROM documents LEFT JOIN weighed USING (doc_id)),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST})
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank
        FROM scored LEFT JOIN placed USING (doc_id)"""
}
