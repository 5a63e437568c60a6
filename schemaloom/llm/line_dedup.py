"""Line deduplication: lines that several documents share stay in one document only.

Lines are compared by a hash of 128 bits of their key. The hashes are dealt out by range and sorted by hash, then by
document, the greatest id first, then by position; going through a range in that order meets the document that keeps a line
first, and how many documents follow. A hash that many rows hold is cut into slices by document, each a range of its own;
what the slices found is put together afterwards. The result is a run-length bitmap for each document that loses lines
(the lines it keeps, as runs), not its text; texts are rebuilt from it only where they are asked for. Everything is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.llm._common import HOT_KEYS, attach, every, fresh, id_text, table, whole_text, written

#: Least code points of a key that counts, and least documents that must hold it.
LEAST, DOCUMENTS = 20, 3
#: What is stripped from both ends of a line, and what is lower-cased.
BLANKS, UPPER, LOWER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many hashes are cut into slices, those with more than 1/SLICED of all rows; hashes that the counting of them tracks.
SLICED, TRACKED = 512, 16384


def lines_of(text: Column) -> Column:
    """The lines of a text; one empty line of an empty text."""
    return F.split(text, "\n", -1)


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc, tk, n, pos, h, g) of every line whose key has ``least`` code points; tk tells rows of one id apart by their texts."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("tk"), lines_of(F.translate(text, UPPER, LOWER)).alias("lines"))
    # explode_outer, as explode would have the optimizer split the texts once more to filter out empty arrays
    each = rows.select("doc", "tk", F.size("lines").alias("n"), F.posexplode_outer("lines").alias("pos", "line"))
    keyed = each.select("doc", "tk", "n", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.length("key") >= least)
    return keyed.select("doc", "tk", "n", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def _frequent(lines: DataFrame) -> DataFrame:
    """(h, slices) of the hashes that hold more than 1/SLICED of all rows, at most SLICED of them: found by a sketch of frequent values, as no result hangs on them."""
    found = lines.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(h, {SLICED}, {TRACKED})").alias("top"))
    each = found.select("rows", F.explode("top").alias("x")).filter((F.col("x.count") > 64) & (F.col("x.count") * SLICED > F.col("rows")))
    return each.select(F.col("x.item").alias("h"), F.ceil(F.col("x.count") * HOT_KEYS / F.col("rows")).cast("long").alias("slices"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc, tk, n_lines, keep, copies) of the documents that lose lines: keep is a bitmap as the runs (begin, length) of its ones.

    docs needs doc_id (of any type with an order) and text. A line's key is the line without white space at both ends, A-Z
    lower-cased; keys of ``least`` code points or more that ``documents`` different ids hold lose all lines but those of the
    greatest id. A null id is an id, less than all others. Rows that share the id keep or lose lines together; tk, a hash of
    the text, tells them apart, copies counts rows that repeat both. Null texts are one empty line. A very long text is split
    where it lies; its lines are dealt out like all others. Empty input gives an empty result, other columns are not looked at.
    """
    lines = written(_occurrences(docs, least), "lines")
    frequent = written(_frequent(lines), "frequent", narrow=True)
    sliced = lines.join(F.broadcast(frequent), "h", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("slices")) + 1, F.lit(0).cast("long"))).drop("slices")
    newest = F.col("doc").desc_nulls_last()
    ranged = sliced.repartitionByRange("h", "slice").sortWithinPartitions("h", "g", "slice", newest, "pos")
    key = Window.partitionBy("h", "g", "slice")  # the ranges have these keys whole, so nothing is shuffled again
    met = ranged.withColumns({"nth": F.dense_rank().over(key.orderBy(newest)), "row": F.row_number().over(key.orderBy(newest))})
    met = met.withColumn("holders", F.max("nth").over(key)).filter((F.col("slice") > 0) | (F.col("holders") >= documents) & (F.col("nth") > 1))
    met = written(met.select("doc", "tk", "n", "pos", "h", "g", "slice", "row", "holders"), "met")
    parts = met.filter("slice > 0 and row = 1").groupBy("h", "g").agg(F.max("doc").alias("last"), F.sum("holders").alias("all"))  # of frequent hashes only
    lost = met.join(F.broadcast(parts), ["h", "g"], "left").filter((F.col("slice") == 0) | (F.col("all") >= documents) & ~F.col("doc").eqNullSafe(F.col("last")))
    gone = lost.groupBy("doc", "tk", "n").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.count(F.lit(1)).alias("rows"))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1) + 1)
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.struct(begin(i).alias("begin"), (F.coalesce(F.get("gone", i), F.col("n")) - begin(i)).alias("length")))
    return gone.select("doc", "tk", F.col("n").alias("n_lines"), F.filter(runs, lambda r: r["length"] > 0).alias("keep"), (F.col("rows") / F.size("gone")).cast("long").alias("copies"))


def deduplicated_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """docs with n_lines, n_dropped (longs) and kept_text, named anew where docs has columns of these names (see ``fresh``); edge cases as in ``keep_bitmaps``.

    The bitmaps are joined to the rows by id and text. Only if they are too many to be broadcast do texts move, once.
    """
    id_, tk = fresh("id", docs), fresh("tk", docs)
    maps = keep_bitmaps(docs.select("doc_id", "text"), least, documents)
    keep, copies = fresh("keep", docs), fresh("copies", docs)
    maps = written(maps.select(id_text("doc").alias(id_), F.col("tk").alias(tk), F.col("keep").alias(keep), F.col("copies").alias(copies)), "bitmaps", narrow=True)
    text = whole_text()
    joined = attach(docs.withColumns({id_: id_text(), tk: F.xxhash64(text)}), maps, [id_, tk], "left", copies)
    lines, runs = fresh("n_lines", docs), F.col(keep)
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines_of(text), r["begin"] + 1, r["length"]))), "\n")
    left = F.aggregate(runs, F.lit(0), lambda a, r: a + r["length"])
    out = joined.select(*every(docs), F.size(lines_of(text)).cast("long").alias(lines), runs.alias(keep), F.when(runs.isNull(), text).otherwise(kept).alias(fresh("kept_text", docs)), left.alias(copies))
    return out.select(*every(docs), lines, F.coalesce(F.col(lines) - F.col(copies), F.lit(0).cast("long")).alias(fresh("n_dropped", docs)), fresh("kept_text", docs))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = {
    "op13_line_dedup": f"""
        WITH l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
                   FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        k AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), {_BLANKS}) AS key FROM l),
        gone AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS})
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
        FROM k LEFT JOIN gone USING (key) GROUP BY doc_id"""
}
