"""Near-duplicates by SimHash: every pair of fingerprints within a Hamming distance, found with vantage-point trees.

The top of a tree is planned from a bounded sample of fingerprints. At each node a vantage point and a
radius part the fingerprints into an inner and an outer side. Every fingerprint has one home shard; it also visits the
shards that its ball reaches: an inner point near the border visits the outer side (never the reverse, so each pair
meets once), and a visitor goes wherever the triangle inequality allows a partner. Vantage points and radii are those
whose border is thinnest for the halving they bring. A shard that is still too large gets a tree of its own. In a shard
the tree goes on until its leaves are small, then distances are compared exactly. A shard returns a spanning forest, not
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from schemaloom.llm._common import attach, slices, table, whole_text, without, written
from schemaloom.llm.components import components

BITS, SEED = 64, 42
#: Words of a shingle, and differing bits that still link.
SHINGLE, RADIUS = 3, 2
#: Fingerprints of a shard that lay out the top of its tree, at most and at least (only the shards' balance hangs on it, never a result).
SAMPLE, DRAWN = 1 << 16, 1 << 13
#: Fingerprints a shard is planned for, those that it may have with its visitors before it is parted again (16 MB), and those a leaf inside it compares directly.
SHARD, CROWD, LEAF = 1 << 17, 1 << 21, 48
#: Vantage points that are tried for a node, and sampled points below which a node isn't parted further.
TRIED, LEAST = 12, 16

_bit_of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is set where over half of them have it; zero of none."""
    bytes_ = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(bytes_.ravel(), minlength=2048).reshape(8, 256) @ _bit_of_byte
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words parted by ASCII white space, a bit where over half the shingles' XXH64 have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return print_of(np.fromiter([digest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)], np.uint64, len(begin)))


def apart(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _cut(points: np.ndarray, reach: int, tried: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius (inner is distance <= radius) that part the points best: the most bits of order for the fewest copies. None if no point parts them."""
    best, most, n = None, 0.0, len(points)
    for k in dict.fromkeys(np.linspace(0, n - 1, tried).astype(int).tolist()):
        shell = np.bincount(apart(points, points[k]), minlength=BITS + 1)
        below = np.cumsum(shell)
        share = below / n
        border = (below - np.concatenate((np.zeros(reach), below[: BITS + 1 - reach]))) / n  # inner points that visit the outer side
        with np.errstate(divide="ignore", invalid="ignore"):
            order = -np.nan_to_num(share * np.log2(share)) - np.nan_to_num((1 - share) * np.log2(1 - share))
        worth = order / np.log2(1.02 + 2 * border)
        radius = int(np.argmax(worth))
        if worth[radius] > most and 0 < below[radius] < n:
            best, most = (points[k], radius), worth[radius]
    return best


def plan(sample: np.ndarray, parts: int, reach: int = RADIUS) -> list:
    """The top of a tree with about ``parts`` leaves in preorder: (vantage point, radius, index of outer child), or (shard number,) for a leaf."""
    nodes: list = []
    shards = 0
    least = max(LEAST, len(sample) // max(1, parts))

    def grow(points: np.ndarray) -> None:
        nonlocal shards
        cut = _cut(points, reach, TRIED) if parts > 1 and len(points) > least else None
        if cut is None:
            nodes.append((shards,))
            shards += 1
            return
        at = len(nodes)
        nodes.append(None)
        inner = apart(points, cut[0]) <= cut[1]
        grow(points[inner])
        nodes[at] = (cut[0], cut[1], len(nodes))
        grow(points[~inner])

    grow(sample)
    return nodes


def _sides(home: np.ndarray, visit: np.ndarray, point: np.uint64, radius: int, reach: int):
    """(home, visitors) of the inner and of the outer side."""
    h, v = apart(home, point).astype(np.int16), apart(visit, point).astype(np.int16)
    inner, near = h <= radius, (h <= radius) & (h + reach > radius)
    return (home[inner], visit[v - reach <= radius]), (home[~inner], np.concatenate([visit[v + reach > radius], home[near]]))


def route(nodes: list, points: np.ndarray, reach: int, guests: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, home, visitors) of the points and of guests, which have no home here."""
    todo = [(0, points, np.zeros(0, points.dtype) if guests is None else guests)]
    while todo:
        at, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], home, visit
            continue
        point, radius, outer = nodes[at]
        first, second = _sides(home, visit, point, radius, reach)
        todo += [(at + 1, *first), (outer, *second)]


def linked(home: np.ndarray, visit: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within home and between home and visitors."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    out: list[tuple[int, int]] = []
    todo = [(home, visit)]
    while todo:
        h, v = todo.pop()
        if not len(h) or len(h) == 1 and not len(v):
            continue
        cut = _cut(h, reach, 4) if len(h) > LEAF else None
        if cut is not None:
            todo += _sides(h, v, *cut, reach)
            continue
        for at in range(0, len(h), LEAF):  # more than a leaf only where no point parts them
            part, others = h[at : at + LEAF], np.concatenate([h[at:], v])
            for step in range(0, len(others), 1 << 16):
                i, j = np.nonzero(apart(part[:, None], others[None, step : step + (1 << 16)]) <= reach)
                for a, b in zip(part[i].tolist(), others[step + j].tolist(), strict=True):
                    if a != b and (x := find(a)) != (y := find(b)):
                        parent[max(x, y)] = min(x, y)
                        out.append((a, b))
    a = np.array([x for x, _ in out], np.uint64)
    b = np.array([y for _, y in out], np.uint64)
    return a, b


def _trees(now: DataFrame, sizes: dict[int, int], reach: int) -> dict[int, list]:
    """A tree for each shard of ``sizes`` (rows by shard) that a cut parts, planned in a task from a sample of the shard's own: a node for each SHARD fingerprints, about, comes back."""
    spark = now.sparkSession
    wanted = spark.createDataFrame([(s, -(-n // SHARD), min(1.0, min(SAMPLE, max(DRAWN, 4 * LEAST * -(-n // SHARD))) / n)) for s, n in sizes.items()], "shard long, parts long, share double")
    drawn = now.filter("home").join(F.broadcast(wanted), "shard").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) / float(1 << 40) < F.col("share"))

    def planned(some: pa.Table) -> pa.Table:
        points = np.sort(some.column("fp").to_numpy()).view(np.uint64)
        nodes = plan(points, some.column("parts")[0].as_py(), reach)
        rows = [(int(np.uint64(x[0]).view(np.int64)), x[1], x[2]) if len(x) == 3 else (x[0], -1, -1) for x in nodes]
        point, radius, outer = (pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*rows, strict=True))
        return pa.table({"shard": some.column("shard")[:1], "point": point, "radius": radius, "outer": outer})

    found = drawn.select("shard", "parts", "fp").groupBy("shard").applyInArrow(planned, "shard long, point array<long>, radius array<long>, outer array<long>").collect()
    trees = {r.shard: [(np.int64(p).view(np.uint64), d, o) if d >= 0 else (p,) for p, d, o in zip(r.point, r.radius, r.outer, strict=True)] for r in found}
    return {s: t for s, t in trees.items() if len(t) > 1}


def _sharded(prints: DataFrame, rows: int, reach: int) -> DataFrame:
    """(shard, home, fp) of the distinct values of fp and their visits; shards of more than CROWD rows are parted again and again, each for itself, but for those that no cut makes smaller."""
    now = prints.select(F.lit(0).cast("long").alias("shard"), F.lit(True).alias("home"), "fp")
    sizes, allowed, whole = {0: rows}, SHARD, set()
    while True:
        big = {s: n for s, n in sizes.items() if n > allowed and s not in whole}
        trees = _trees(now, big, reach) if big else {}
        whole |= set(big) - set(trees)
        if not trees:
            return now
        begins, first = {}, max(sizes) + 1
        for shard in sorted(trees):
            begins[shard] = first
            first += sum(len(x) == 1 for x in trees[shard])
        held = now.sparkSession.sparkContext.broadcast((begins, trees))

        def spread(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            begins, trees = held.value
            for batch in batches:
                shard, home, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for s in np.unique(shard).tolist():
                    mine = shard == s
                    points, at_home = fp[mine].view(np.uint64), home[mine]
                    out += [(begins.get(s, s) + leaf, inside, visit) for leaf, inside, visit in route(trees.get(s, [(0,)]), points[at_home], reach, points[~at_home])]
                if out:
                    n = [len(inside) + len(visit) for _, inside, visit in out]
                    to = np.repeat([s for s, _, _ in out], n)
                    stays = np.concatenate([np.arange(k) < len(inside) for k, (_, inside, _) in zip(n, out, strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(stays), pa.array(np.concatenate([x for _, inside, visit in out for x in (inside, visit)]).view(np.int64))], ["shard", "home", "fp"])

        now = written(now.mapInArrow(spread, "shard long, home boolean, fp long"), "sharded", narrow=True)
        allowed, before, sizes = CROWD, sizes, dict(map(tuple, now.groupBy("shard").count().collect()))  # a row for each shard
        for shard, tree in trees.items():
            leaves = range(begins[shard], begins[shard] + sum(len(x) == 1 for x in tree))
            whole.update(s for s in leaves if sizes.get(s, 0) >= before[shard])


def hamming_links(prints: DataFrame, rows: int, reach: int = RADIUS) -> DataFrame:
    """(a, b) longs: links between the distinct values of the long column fp that keep every component of the graph "differs in at most reach bits"; rows: how many there are."""

    def join(shard: pa.Table) -> pa.Table:
        points, home = shard.column("fp").to_numpy().view(np.uint64), shard.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b = linked(points[home], points[~home], reach)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return _sharded(prints, rows, reach).groupBy("shard").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id, text_sha256.

    component_id is the smallest id that is reachable over links, the document itself included; ids are of any type with
    an order. Null texts count as empty; texts without words have fingerprint zero, linked like any other. A null id is
    never the smallest; a component of null ids only has a null component_id. Repeated rows get repeated rows. Empty
    input: empty result. Other columns, whatever their names, are not looked at. A very long text is one Python object
    at a time, its shingles' hashes an array.
    """
    text, kind = whole_text(text_col), docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType()), StructField("text_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([simhash(t.as_buffer().to_pybytes(), shingle) for t in batch.column(1).cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_sha256"])

    rows = written(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256")).mapInArrow(run, schema), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct", narrow=True)
    edges = written(hamming_links(prints, prints.count(), reach), "links", narrow=True)
    roots = written(components(edges).withColumnRenamed("node", "fp"), "roots", narrow=True)
    grouped = attach(prints.withColumnRenamed("n", "size"), roots, ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = written(grouped.select("fp", "root", "low", "size"), "grouped", narrow=True)
    lowest = written(grouped.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")), "lowest", narrow=True)
    labels = written(attach(grouped, lowest, ["root"], "left", "n").select("fp", "component_id", F.col("size").alias("n")), "labels", narrow=True)
    out = attach(rows, labels, ["fp"], "left", "n")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_sha256")


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """docs with those rows whose doc_id is their component's smallest; a component without any id keeps all its rows.

    All columns are kept as they are. Null texts count as empty; all texts without words are one component. Rows that repeat
    the smallest id with the same text stay together. Empty input gives an empty result.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    return without(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_sha256")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
