"""What the corpus operators share: the shared folder, written intermediates, joins that survive hot keys.

Nothing here collects data whose size grows with the input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: A table of at most so many rows and bytes may be broadcast (both are measured first); beyond either the join shuffles.
#: They are low because an operator holds several such tables at a time, each several times as large in memory.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20
#: Rows of a few numbers each that may be broadcast instead where all texts would be shuffled otherwise.
NUMBERS = 500_000
#: At most so many keys count as hot, because each holds more than 1/HOT_KEYS of all rows.
HOT_KEYS = 4096
#: Files that a core writes of a narrow table.
NARROW_FILES = 4
#: Rows of an Arrow batch that are worked on at a time, and rows that Spark puts into a batch (its own default is 10,000, which of whole texts may be very much).
SLICE, BATCH = 256, 2000


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to be none of the frames' columns."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset a temporary folder is made and set in local mode only, as in tests; on a cluster it is an error, as executors do not share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="schemaloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    return f"{root.rstrip('/')}/schemaloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, lost executors cost no recomputation.

    ``narrow``: the rows are few or short, such as counts by key, so a core writes at most NARROW_FILES files.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    if narrow:
        df = df.coalesce(NARROW_FILES * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table may be broadcast: its rows are counted and its texts, binaries and arrays measured."""
    if df.count() > rows:
        return False
    wide = [f.name for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType))]
    return not wide or (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0) <= BROADCAST_BYTES


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", weight: str | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a written table ``right`` with one row for each key in ``on``; how: left, inner, left_semi or left_anti.

    ``weight``: the column of ``right`` with the number of ``left``'s rows that hold the key; where it is not given, these
    are counted if they are needed. A right side that is ``small`` is broadcast. Otherwise a key that holds over 1/HOT_KEYS
    of all rows is parted: its left rows are dealt out and its right row is copied to each part, 2 * HOT_KEYS copies at
    most for all such keys. Only the hot keys and their numbers of parts are broadcast, and no key gathers in one task.
    The sides share no column but ``on``; columns with the names used here inside are left as they are.
    """
    on = list(on)
    if small(right, limit):
        return left.join(F.broadcast(right), on, how)
    extra = weight is None
    if extra:
        weight = fresh("weight", left, right)
        right = written(right.join(left.groupBy(*on).agg(F.count(F.lit(1)).alias(weight)), on), "weighed")
    least = max(64, (right.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS)
    parts, part = fresh("parts", left, right), fresh("part", left, right)
    number = F.ceil(F.col(weight) / least).cast("int")
    hot = right.filter(F.col(weight) > least).select(*on, number.alias(parts))
    dealt = left.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn(part, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    copied = right.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1)))
    out = dealt.join(copied.drop(weight) if extra else copied, [*on, part], how)
    others = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on and not (extra and c == weight)]
    return out.select(*every(left), *others)


def id_text(column: str = "doc_id") -> Column:
    """An id as a text that is never null, to join by; the text of no other id is that of null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are those of a row of ``dropped`` (doc_id, text_sha256).

    Both are compared as 128 bits of hashes, so that many rows' keys may be broadcast and the texts don't move.
    """
    key, more, sha = fresh("key", docs), fresh("more", docs), fresh("sha", docs)
    bits = lambda x: {key: F.xxhash64(id_text(), x), more: F.xxhash64(F.lit(1), id_text(), x)}
    drop = written(dropped.select(*[c.alias(n) for n, c in bits(F.col("text_sha256")).items()]).distinct(), "dropped", narrow=True)
    keyed = docs.withColumn(sha, F.sha2(whole_text(), 256)).withColumns(bits(F.col(sha)))
    return attach(keyed, drop, [key, more], "left_anti", limit=NUMBERS).select(*every(docs))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that few whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
