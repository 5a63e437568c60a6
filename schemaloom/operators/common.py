"""What operators share: scalar columns, the value index, checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text, so that every column can be grouped and compared."""
    complex_ = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, complex_) else F.col(f"`{f.name}`") for f in df.schema])


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to be none of the frames' columns."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Characters beyond which a value that is no number stands for itself by its digest where only equality counts.
LONG = 256


def cells(df: DataFrame, digests: bool = False) -> DataFrame:
    """(col, pos, value): a row for each cell, the value as text; null stays null.

    ``digests``: long texts are their SHA-256, for what only counts and compares values, so that whole documents don't
    travel as keys of a shuffle.
    """
    df = scalar(df)
    each = F.array(*[F.struct(F.lit(f.name).alias("col"), F.lit(i).alias("pos"), F.col(f"`{f.name}`").cast("string").alias("value")) for i, f in enumerate(df.schema)])
    out = df.select(F.explode(each).alias("c")).select("c.*")
    if not digests:
        return out
    text = F.col("value")
    return out.withColumn("value", F.when((F.length(text) > LONG) & ~text.rlike(r"^\s*[-+0-9.eE]+\s*$"), F.concat(F.lit("sha256 "), F.sha2(text, 256))).otherwise(text))


def value_index(df: DataFrame, digests: bool = False) -> DataFrame:
    """(col, pos, value, cnt): how often each value of each column occurs; counted before the shuffle. ``digests``: as in ``cells``."""
    return cells(df, digests).groupBy("col", "pos", "value").agg(F.count(F.lit(1)).alias("cnt"))


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a temporary folder is set in local mode only; on a cluster it is an error, as executors do not share such a folder."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and held.isDefined():
        root = held.get()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="schemaloom-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage through the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
