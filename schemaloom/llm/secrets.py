"""Secret scanning with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table of (blob, rule, version,
scan, spans); only pairs of a blob and a rule version that it lacks are scanned, each distinct content once. What is
unseen is found by the shuffle that brings equal contents together: the ledger's pairs take part in it. A row of the
ledger is whole by itself, so a write that breaks off loses nothing: the next run scans the pairs that are missing.
Findings are joined back to all paths by blob. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.llm._common import NARROW_FILES, attach, id_text, shared_dir, table, whole_text, written


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax, no lookaround needed); of its matches those whose ``group`` has ``least`` characters count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base rules. A run of hex digits or of an access key's letters that is too short has no longer match inside it, so their least length stands in the pattern; an assignment that is too short still uses up its text.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
LEDGER = "blob binary, rule string, version int, scan int, spans array<struct<start:long,end:long>>"
#: Arrivals that the query scans one after another.
ARRIVALS = 2


def _parts(rule: Rule) -> Column:
    """A rule's matches in ``text`` in order: length of the text before each, of the match and of its value; null if there is none."""
    found = lambda group: F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group)), F.length)
    parts = F.arrays_zip(F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"), found(0).alias("size"), found(rule.group).alias("value"))
    return F.when(F.col("text").rlike(rule.pattern), parts)


def _scanned(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of the ledger for (blob, text, done): gaps and matches follow each other, so their lengths add up to places."""
    each = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(~F.array_contains("done", r.kind), F.struct(_parts(r).alias("parts"))).alias("scan")) for r in rules])
    pairs = blobs.select("blob", F.explode_outer(each).alias("x")).filter("x.scan is not null")
    parts = pairs.select("blob", "x.rule", "x.version", "x.least", F.posexplode_outer("x.scan.parts").alias("pos", "part")).filter("pos is null or part.size is not null")
    so_far = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.col("part.size")).over(so_far)
    placed = parts.withColumn("end", end)
    span = F.when(F.col("part.value") >= F.col("least"), F.struct((F.col("end") - F.col("part.size")).alias("start"), "end"))
    return placed.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))


class SecretLedger:
    """The ledger below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), tuple(rules)

    def read(self) -> DataFrame:
        """All rows; none if nothing was ever scanned."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(LEDGER).parquet(self.path)
        return self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, text_col: str = "text") -> int:
        """Scan the pairs that are new in ``versions`` (any columns beside the text) and append them to the ledger; the number of the scan, from 1."""
        text = whole_text(text_col)
        blobs = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"), F.lit(None).cast("string").alias("rule"))
        known = self.read()
        number = 1 + (known.agg(F.max("scan")).first()[0] or 0)
        seen = F.lit(False)
        for r in self.rules:
            seen |= (F.col("rule") == r.kind) & (F.col("version") == r.version)
        blobs = blobs.union(known.filter(seen).select("blob", F.lit(None).cast("string"), "rule"))
        blobs = blobs.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"), F.collect_set("rule").alias("done"))
        unseen = blobs.filter(F.col("text").isNotNull() & (F.size("done") < len(self.rules)))
        rows = _scanned(unseen, self.rules).select("blob", "rule", "version", F.lit(number).alias("scan"), "spans")
        rows.coalesce(NARROW_FILES * self.spark.sparkContext.defaultParallelism).write.mode("append").parquet(self.path)
        return number

    def findings(self) -> DataFrame:
        """(blob, spans array<struct<start,end,kind>>) by start, then kind in the rules' order, of blobs that have any."""
        order = {r.kind: (i, r.version) for i, r in enumerate(self.rules)}
        current = [r.kind for r in self.rules]
        rows = self.read().filter(F.size("spans") > 0).filter(F.col("rule").isin(current))
        versions = F.create_map(*[F.lit(x) for k, (_, v) in order.items() for x in (k, v)])
        place = F.create_map(*[F.lit(x) for k, (i, _) in order.items() for x in (k, i)])
        rows = rows.filter(F.col("version") == versions[F.col("rule")]).dropDuplicates(["blob", "rule"])
        each = rows.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("rule")].alias("place"), s["end"].alias("end"), F.col("rule").alias("kind"))).alias("spans"))
        return each.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))  # a row for each rule

    def scans(self) -> DataFrame:
        """(scan, rule, version, pairs): how many pairs of a blob and a rule version each scan had to do."""
        return self.read().groupBy("scan", "rule", "version").agg(F.count(F.lit(1)).alias("pairs"))


def with_findings(versions: DataFrame, ledger: SecretLedger, text_col: str = "text") -> DataFrame:
    """versions without the text column, with blob (binary) and secret_spans (array of start, place, end, kind; empty where none) from the ledger.

    Columns of those two names are replaced, others are kept as they are. Null texts count as empty; repeated rows each
    get the findings; empty input gives an empty result. A very long text is matched where it lies, by Spark's own regular
    expressions.
    """
    found = written(ledger.findings(), "findings", narrow=True)
    keyed = versions.drop("blob", "secret_spans").withColumn("blob", F.unhex(F.sha2(whole_text(text_col), 256)))
    others = [c for c in keyed.columns if c not in ("blob", text_col)]
    plain = lambda c: F.col("`" + c.replace("`", "``") + "`")
    narrow = keyed.select(F.struct(F.lit(0).alias("c"), *[plain(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), "blob")
    spans = F.coalesce(F.col("spans"), F.array().cast(found.schema["spans"].dataType)).alias("secret_spans")
    return attach(narrow, found, ["blob"], "left").select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(others)], "blob", spans)


def secret_scan(versions: DataFrame, ledger: SecretLedger, text_col: str = "text") -> DataFrame:
    """``with_findings`` after a scan of what is new in versions."""
    ledger.scan(versions, text_col)
    return with_findings(versions, ledger, text_col)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, whose ids may be of any type, null or repeated; documents are dealt into the arrivals by their ids."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), SecretLedger(spark, shared_dir(spark, "ledger"))
    number = F.coalesce(F.col("doc_id").cast("string").try_cast("long"), F.crc32(id_text().cast("binary")))
    for arrival in range(ARRIVALS):
        ledger.scan(docs.filter(F.pmod(number, F.lit(ARRIVALS)) == arrival))
    out = with_findings(docs, ledger)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("secret_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


_KINDS = {r.kind: r for r in RULES}


def _sql(kind: str, place: int) -> str:
    rule = _KINDS[kind]
    pattern = rule.pattern.replace("'", "''").replace('\\"', '"')
    return f"""
        SELECT doc_id, {place} AS place, '{kind}' AS kind, size, value,
               list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_slice(sizes, 1, i - 1)), 0) AS start
        FROM (SELECT doc_id, gaps, sizes, unnest(sizes) AS size, unnest(vals) AS value, unnest(range(1, len(sizes) + 1)) AS i
              FROM (SELECT doc_id, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps,
                           list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes,
                           list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS vals
                    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
        WHERE value >= {rule.least}"""


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE = {
    "op6_secret_scan": f"""
        WITH found AS ({' UNION ALL '.join(_sql(r.kind, i) for i, r in enumerate(RULES))}),
        joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                          count(*) FILTER (kind = 'hex') AS n_hex,
                          string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place) AS spans
                   FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN joined USING (doc_id)"""
}
