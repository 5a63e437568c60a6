"""Exact token counts for every context limit from a histogram of encoded lengths.

Documents are aggregated by their encoded length; the histogram has a row for each length that occurs. Suffix sums over it
answer how many documents and tokens lie beyond any limit, and from these how many tokens remain under it and every
quantile. A suffix is put together from nodes of a tree over the lengths' digits, so no task gets the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.llm._common import attach, slices, table, whole_text, written
from schemaloom.llm.bpe import load, tokenizer_path

#: Bits of a digit, and digits of a length: every node of the tree has at most 2**DIGIT children, lengths may have DIGIT * DIGITS bits.
DIGIT, DIGITS = 6, 6


def token_lengths(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row's whole text; null counts as empty, repeated rows count each, other columns are not looked at.

    A very long text is one Python object at a time. Empty input gives an empty result.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, spec.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(bpe.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): a row for each length; rows of the same length are counted before the shuffle. A null length is no document and is left out."""
    return lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_cut, tokens_cut) of a written histogram: documents longer than each length, and their tokens.

    The digits of a length name its ancestors in a tree. What is longer than a length is the sum over its ancestors of
    their later siblings, of which a node has fewer than 2**DIGIT.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(DIGITS - 1))).alias("level")
    node = F.expr(f"shiftright(n_tokens, level * {DIGIT})").alias("node")
    paths = hist.select("n_tokens", "n_docs", level).select("*", node)
    nodes = paths.groupBy("level", "node").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("lengths"))
    later = Window.partitionBy("level", F.expr(f"shiftright(node, {DIGIT})")).orderBy(F.col("node").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = nodes.select("level", "node", F.sum("docs").over(later).alias("docs"), F.sum("tokens").over(later).alias("tokens"), "lengths")
    found = attach(paths, written(after, "siblings", narrow=True), ["level", "node"], "inner", "lengths")
    zero = F.lit(0).cast("long")
    return found.groupBy("n_tokens", "n_docs").agg(F.coalesce(F.sum("docs"), zero).alias("docs_cut"), F.coalesce(F.sum("tokens"), zero).alias("tokens_cut"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: n_docs of that length, docs_within, tokens_within (documents up to it), docs_cut (longer ones), truncated_tokens (all documents cut at it), share_within (its quantile).

    An empty histogram gives an empty result.
    """
    hist = written(hist, "histogram", narrow=True)
    totals = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    out = suffix_sums(hist).crossJoin(F.broadcast(totals))  # one row
    within, kept = F.col("docs") - F.col("docs_cut"), F.col("tokens") - F.col("tokens_cut")
    return out.select("n_tokens", "n_docs", within.alias("docs_within"), kept.alias("tokens_within"), "docs_cut", (kept + F.col("docs_cut") * F.col("n_tokens")).alias("truncated_tokens"), (within / F.col("docs")).alias("share_within"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(truncated_tokens) of any limit, also between lengths that occur; sums is the result of ``limits``."""
    below = sums.filter(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "tokens_within", "docs_cut")).alias("x"))
    every = sums.agg(F.sum("n_docs").alias("docs"))
    return below.crossJoin(F.broadcast(every)).select(F.coalesce(F.col("x.tokens_within") + F.col("x.docs_cut") * limit, F.col("docs") * limit, F.lit(0)).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that holds a share q of the documents."""
    return sums.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(token_lengths(table(spark, sf_dir, "documents"))))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
