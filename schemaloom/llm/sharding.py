"""A shard store with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of similar size (a tier: sizes within a factor) are
packed into runs that together make a file of about the target size; a run is rewritten as one shard. Each append or
compaction ends with one atomic step, the renaming of a version's pointer file to a name that must not exist yet:
readers see the old version or the new one, and of two writers one fails and can try again on the newer version. Data
files are never changed; a file that no manifest names is not part of the store. Everything is DataFrame expressions.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from schemaloom.llm._common import attach, shared_dir, table, written

#: Bytes of a full shard; the factor between tiers; least shards of a run worth rewriting.
TARGET, FACTOR, LEAST = 64 << 20, 4, 4
#: Shards of a tier that are packed together, on average; each such bin leaves one run at most that is not full.
BIN = 1024
#: The query: arrivals that are appended one after another, arriving shards that make a full one, and the least and greatest target.
ARRIVALS, SMALL, TARGETS, FILES = 4, 16, (1 << 17, TARGET), 8


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """The store below a folder that all executors share.

    Rows are kept as they are: nulls in any column, repeated rows and any columns, whatever their names (reading gives
    them inside the struct ``row``). An append without rows makes a version without new shards.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, factor: int = FACTOR, least: int = LEAST):
        self.spark, self.path, self.target, self.factor, self.least = spark, path.rstrip("/"), target, factor, least
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        folder = self._hadoop.fs.Path(f"{self.path}/versions")
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, folder, rows, bytes, level, since) of a version's shards; shard is the file's path."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the store has no version yet")
        return self.spark.read.parquet(f"{self.path}/manifests/{self._pointer(version)[0]}")

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version's rows."""
        return StructType.fromJson(json.loads(self._pointer(self.version() if version is None else version)[1]))

    def _pointer(self, version: int) -> list[str]:
        return self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()[0].split("\n", 1)

    def _commit(self, version: int, manifest: DataFrame, schema: StructType) -> int:
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.path}/manifests/{name}")
        path = self._hadoop.fs.Path
        draft, final = path(f"{self.path}/drafts/{name}"), path(f"{self.path}/versions/{version:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(f"{name}\n{schema.json()}".encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(self._hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(draft, final, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"version {version} exists") from None
            raise
        return version

    def _written(self, df: DataFrame, level: int | Column, version: int, shard_rows: int = 0) -> DataFrame:
        """df as new files of at most ``shard_rows`` rows (0: any number); their manifest rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", shard_rows).parquet(folder)
        files = self.spark.read.schema(df.schema).parquet(folder).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        rows = files.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.first("bytes").alias("bytes"))
        return rows.select("shard", F.lit(folder).alias("folder"), "rows", "bytes", F.lit(level).alias("level"), F.lit(version).cast("long").alias("since"))

    def append(self, arrivals: DataFrame, shard_rows: int = 0) -> int:
        """Write arrivals as new shards, one or more for each of their partitions, of at most ``shard_rows`` rows if that is given, and commit; the new version.

        Arrivals must have the columns that the store has.
        """
        version = self.version() + 1
        if version > 1 and [(f.name, f.dataType) for f in self.schema()] != [(f.name, f.dataType) for f in arrivals.schema]:
            raise ValueError("arrivals have other columns than the store")
        new = self._written(arrivals, 0, version, shard_rows)
        return self._commit(version, new if version == 1 else self.manifest(version - 1).unionByName(new), arrivals.schema)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(shard, folder, run): which shards to rewrite together; runs are numbered from 0. Full shards rest; a run has ``least`` shards or more, or fills a target file."""
        small = manifest.filter(F.col("bytes") < self.target // 2)
        bins = max(1, small.count() // BIN)
        tier = F.floor(F.log(float(self.factor), F.greatest("bytes", F.lit(1)).cast("double"))).cast("int")
        dealt = small.withColumn("tier", tier).withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)))
        order = Window.partitionBy("tier", "bin").orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = dealt.withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / self.target))
        run = F.concat_ws("/", "tier", "bin", "part").alias("run")
        runs = runs.select("shard", "folder", "bytes", run)
        worth = runs.groupBy("run").agg(F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("size")).filter((F.col("shards") >= self.least) | (F.col("shards") >= 2) & (F.col("size") >= self.target))
        numbered = worth.select("run", (F.row_number().over(Window.orderBy("run")) - 1).alias("number"))  # a row for each file to be written
        return runs.join(numbered, "run").select("shard", "folder", F.col("number").alias("run"))

    def _rows(self, shards: DataFrame, schema: StructType) -> DataFrame:
        """The rows of the shards (shard, folder, any columns); columns of the data in the struct ``row``."""
        folders = [r[0] for r in shards.select("folder").distinct().collect()]  # one for each append or compaction that still has shards
        data = self.spark.read.schema(schema).parquet(*(folders or [f"{self.path}/data/*"]))
        rows = data.select(F.struct(*[F.col(f"`{c}`") for c in data.columns]).alias("row"), F.col("_metadata.file_path").alias("shard"))
        return attach(rows, shards.drop("folder"), ["shard"], "inner", "rows")

    def read(self, version: int | None = None) -> DataFrame:
        """row (struct of the data's columns), shard, bytes, level, since, rows of every row of a version."""
        return self._rows(self.manifest(version), self.schema(version))

    def compact(self) -> int:
        """Rewrite runs, tier after tier, until no run is worth it; the newest version. Each round is committed."""
        while True:
            version = self.version()
            manifest = self.manifest(version)
            plan = written(self.plan(manifest).join(manifest.select("shard", "rows", "level"), "shard"), "plan", narrow=True)
            runs, level = plan.agg(F.count_distinct("run"), F.max("level")).first()
            if not runs:
                return version
            schema = self.schema(version)
            rows = self._rows(plan, schema).repartitionById(runs, F.col("run")).select("row.*")
            new = self._written(rows, level + 1, version + 1)
            kept = manifest.join(plan, "shard", "left_anti")
            self._commit(version + 1, kept.unionByName(new), schema)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is read from."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    return files.agg(F.sum("size")).first()[0] or 0


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts as small shards, a SMALL-th of the target each; the target is a FILES-th of the table within TARGETS."""
    docs = table(spark, sf_dir, "documents")
    size, rows = stored_bytes(docs), docs.count()
    target = min(max(size // FILES, TARGETS[0]), TARGETS[1])
    shard_rows = max(1, rows * target // (SMALL * max(1, size)))
    store = ShardStore(spark, shared_dir(spark, "shards"), target)
    arrival = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(ARRIVALS))
    for i in range(ARRIVALS):
        store.append(docs.filter(arrival == i), shard_rows)
    version = store.compact()
    name = F.element_at(F.split("shard", "/"), -1)
    return store.read(version).select(F.col("row.doc_id").alias("doc_id"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"), name.alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("level").alias("shard_level"), F.col("since").alias("shard_since"), F.lit(version).cast("long").alias("version"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE: dict[str, str] = {}
