"""Benchmark decontamination: short test items are searched inside documents by MinHash containment.

Items are parted by size. An item's sketch is its least shingle hashes (the bottom-k MinHash), so many that a document
which holds the required share of the item must hold one of them: with n shingles, at most n // 5 may be missing at a
containment of 0.8, so n // 5 + 1 are kept. A document's shingle hashes are compared with the sketches of each size
class that it is long enough for, up to that class's greatest kept hash. What this leaves is verified by exact shingles:
a document and an item become a pair over one of the item's n // 5 + 1 shingles that the fewest items have, so a line
that all items share makes no pairs, and each pair's shared shingles are counted. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import attach, small, table, whole_text, without, written

#: Words of a shingle; the least containment as a fraction (0.8).
WIDTH, SHARE = 5, (4, 5)
#: Items that a list of a shingle's items has at most.
LIST = 256
#: Fixed value: what parts words, as a regular expression that Java and RE2 read alike.
GAP = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _shingled(text: Column, make) -> Column:
    """A struct of the number of windows and ``make`` of each; a text of fewer words is one window, one without words has none.

    The words are bound as a lambda's argument, so that they are split once and not for each window.
    """

    def windows(words: Column) -> Column:
        n = F.size(words)
        each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: make([F.get(words, i + k) for k in range(WIDTH)]))
        one = F.array(make([F.array_join(words, " ")]))
        return F.struct(F.greatest(n - (WIDTH - 1), F.least(n, F.lit(1))).alias("windows"), F.when(n >= WIDTH, each).when(n > 0, one).alias("shingles"))

    return F.get(F.transform(F.array(_words(text)), windows), 0)


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _needed(n: Column) -> Column:
    """Shingles of n that must be shared."""
    return F.ceil(n * SHARE[0] / SHARE[1]).cast("long")


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_ids, shingles, hashes, n): one row for each different sequence of words, with the ids that have it."""
    words = benchmark.select(F.col(id_col).alias("item_id"), F.array_join(_words(whole_text(text_col)), " ").alias("words")).filter("words <> ''")
    rows = words.groupBy("words").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    rows = rows.withColumn("shingles", F.array_distinct(_shingled(F.col("words"), _text)["shingles"])).withColumn("hashes", F.array_sort(F.array_distinct(_shingled(F.col("words"), _hash)["shingles"])))
    return rows.select(F.sha2("words", 256).alias("item"), "item_ids", "shingles", "hashes", F.size("shingles").cast("long").alias("n"))


def _kept(n: Column) -> Column:
    """So many of n shingles that a document with the required share must have one of them."""
    return (n - _needed(n) + 1).cast("int")


def _candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (sha) of documents that hold a sketched hash of an item that they are long enough for."""
    sketch = items.select(_needed(F.col("n")).alias("need"), _size_class(F.col("n")).alias("size_class"), F.explode(F.slice("hashes", F.lit(1), _kept(F.col("n")))).alias("h"))
    by_hash = written(sketch.groupBy("size_class", "h").agg(F.min("need").alias("need")), "by_hash", narrow=True)
    classes = by_hash.groupBy("size_class").agg(F.max("h").alias("most"), F.min("need").alias("need")).orderBy("size_class").collect()  # a row for each power of two
    ceiling = F.lit(None).cast("long")
    for c in classes:
        ceiling = F.greatest(ceiling, F.when(F.col("doc_n") >= c["need"], F.lit(c["most"])))
    shingled = docs.select("sha", _shingled(F.col("text"), _hash).alias("s")).select("sha", F.col("s.windows").alias("doc_n"), F.col("s.shingles").alias("hashes"))
    # explode_outer, as explode would have the optimizer compute the hashes once more to filter out empty arrays
    hashes = shingled.select("sha", "doc_n", ceiling.alias("ceiling"), F.explode_outer("hashes").alias("h")).filter("h <= ceiling").select("sha", "doc_n", "h")
    own = [F.when((F.col("doc_n") >= c["need"]) & (F.col("h") <= c["most"]), F.lit(c["size_class"])) for c in classes]
    hashes = hashes.withColumn("size_class", F.explode(F.array_compact(F.array(*own).cast("array<int>"))))
    return attach(hashes, by_hash, ["size_class", "h"], "inner").filter("doc_n >= need").select("sha").distinct()


def _met(hits: DataFrame, rare: DataFrame) -> DataFrame:
    """Distinct (sha, item) of the written hits (sha, shingle) and rare (item, shingle).

    A shingle's items are kept in lists of about LIST, and a hit meets each of them, so neither a shingle that many documents
    hold nor one that many items hold gathers in one task (see ``attach``).
    """
    lists = written(rare.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("lists")), "lists", narrow=True)
    dealt = attach(rare, lists, ["shingle"], "inner").withColumn("list", F.pmod(F.xxhash64("item"), F.col("lists")).cast("int"))
    items = written(dealt.groupBy("shingle", "list").agg(F.collect_list("item").alias("items")), "shared", narrow=True)
    each = attach(hits, lists, ["shingle"], "inner").withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)))
    return attach(each, items, ["shingle", "list"], "inner").select("sha", F.explode("items").alias("item")).distinct()


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(sha, item, item_ids, shared, shingles) of the distinct texts of docs (sha, text) that hold 0.8 or more of an item's shingles."""
    items = written(items_of(benchmark, id_col, text_col), "items", narrow=True)
    some = written(_candidates(docs, items), "candidates", narrow=True)
    texts = attach(docs.select("sha", "text"), some, ["sha"], "left_semi").groupBy("sha").agg(F.first("text").alias("text"))
    shingles = written(texts.select("sha", F.explode_outer(F.array_distinct(_shingled(F.col("text"), _text)["shingles"])).alias("shingle")), "shingles")  # of candidates only
    owned = items.select("item", "n", F.explode("shingles").alias("shingle"))
    held = written(owned.groupBy("shingle").agg(F.count(F.lit(1)).alias("owners")), "held", narrow=True)
    hits = written(attach(shingles, held, ["shingle"], "inner").select("sha", "shingle"), "hits", narrow=True)  # a text's shingles are distinct
    ranked = attach(owned, held, ["shingle"], "inner", "owners").groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("owners", "shingle"))).alias("s"))
    rare = written(ranked.select("item", F.explode(F.slice("s", F.lit(1), _kept(F.col("n")))["shingle"]).alias("shingle")), "rare", narrow=True)
    met = hits.join(F.broadcast(rare), "shingle").select("sha", "item").distinct() if small(rare) else _met(hits, rare)
    pairs = written(met, "pairs", narrow=True)
    each = attach(pairs, items.select("item", "item_ids", "n", "shingles"), ["item"], "inner").select("sha", "item", "item_ids", "n", F.explode("shingles").alias("shingle"))
    shared = attach(each, hits, ["sha", "shingle"], "inner").groupBy("sha", "item").agg(F.first("item_ids").alias("item_ids"), F.count(F.lit(1)).alias("shared"), F.first("n").alias("shingles"))
    return shared.filter(F.col("shared") * SHARE[1] >= F.col("shingles") * SHARE[0])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs whose text holds an item: id, n_items, item_ids (comma-joined, ascending), containment.

    Words are runs of letters and digits, in lower case; a shingle is five of them, a text of fewer is one shingle, so an
    item of one to four words is found where it is the whole document.
    containment is the greatest share of an item's distinct shingles that the document has, 0.8 or more. Null and empty
    texts and items without words match nothing. Repeated rows are reported each, items with the same words together.
    Empty input on either side gives an empty result. Other columns, whatever their names, are not looked at. Of a very
    long text one task holds the shingles.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    found = contained(rows.select("sha", "text"), benchmark)
    ids = F.array_sort(F.flatten(F.collect_list("item_ids")))
    by_text = written(found.groupBy("sha").agg(ids.alias("ids"), F.max(F.col("shared") / F.col("shingles")).alias("containment")), "by_text", narrow=True)
    out = attach(rows.select("doc_id", "sha"), by_text, ["sha"], "inner")
    return out.select(F.col("doc_id").alias(id_col), F.size("ids").cast("long").alias("n_items"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("item_ids"), "containment", F.col("sha").alias("text_sha256"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item of the benchmark (item_id, text); all columns are kept as they are."""
    return without(docs, contamination(docs.select("doc_id", "text"), benchmark))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_sha256")


def _sql_shingles(name: str, key: str) -> str:
    return f"""
        SELECT DISTINCT {key}, CASE WHEN len(w) >= {WIDTH} THEN array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') ELSE array_to_string(w, ' ') END AS s
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i
              FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{GAP}'), lambda x: x <> '') AS w FROM {name}) WHERE len(w) > 0)"""


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE = {
    "op8_decontaminate": f"""
        WITH d AS ({_sql_shingles('documents', 'doc_id')}), i AS ({_sql_shingles('benchmark', 'item_id')}),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
        pairs AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids,
               max(CAST(shared AS DOUBLE) / n) AS containment
        FROM pairs JOIN n USING (item_id) WHERE shared * {SHARE[1]} >= n * {SHARE[0]} GROUP BY doc_id"""
}
