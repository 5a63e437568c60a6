"""The pipeline's near-duplicate stage: groups of texts with a five-word Jaccard similarity of 0.8 or more.

Texts that nearly agree are linked first, by SimHash fingerprints of five-word shingles and the vantage-point trees of
``simhash``. At 0.8 fingerprints differ by about 10 of 64 bits, strangers by 32 +- 4; there the triangle bound excludes
nothing and a tree would compare all with all. So the wider reach is by MinHash bands: texts that share a band's four
least hashes form a group, whose leader is compared with each member. What leaders don't join is compared inside the
group, if it is small, and only between different components; a large group is parted by its members' further bands. All
links, the trees' too, are verified by the exact similarity of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from schemaloom.llm._common import attach, slices, whole_text, without, written
from schemaloom.llm.components import components
from schemaloom.llm.simhash import RADIUS, SEED, hamming_links, print_of

#: Words of a shingle, and the least Jaccard similarity as a fraction.
SHINGLE, JACCARD = 5, (4, 5)
#: MinHash bands and the hashes of each: texts of similarity 0.8 share none of the bands with a chance of 0.00008. HASHES in all estimate similarities.
BANDS, ROWS, HASHES = 18, 4, 216
#: Equal hashes from which a pair is verified, in two rounds: 0.8 of HASHES, then three standard deviations less; and differing bits of the fingerprint, four off what 0.8 makes likely.
EQUAL, APART = (173, 155), 22
#: Members of a group that are compared with each other directly, and bytes of texts whose shingles a verifying task remembers.
LEAF, REMEMBERED = 2048, 1 << 20

_draw = np.random.default_rng(SEED)
_factor = _draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_offset = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_set(text: bytes) -> set[bytes]:
    """The different five-word shingles of a UTF-8 text, words as in ``simhash``; a text of fewer words is one shingle."""
    words = text.lower().split()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both * JACCARD[1] >= (len(a) + len(b) - both) * JACCARD[0]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The different XXH64 of the shingles of a text's words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[: max(1, len(words) - SHINGLE + 1)].tolist(), end[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64, len(begin)))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions, from 64-bit hashes of the shingles."""
    out = np.full(HASHES, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        out = np.minimum(out, ((hashes[at : at + 1024, None] * _factor + _offset) >> np.uint64(32)).min(axis=0))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(BANDS, dtype=np.uint64)
    for batch in slices(batches):
        rows = []
        for t in batch.column(2).cast(pa.large_binary()):
            words = t.as_buffer().to_pybytes().lower().split()
            hashes = shingle_hashes(words)
            bands, low = [], b""
            if len(hashes):
                least = least_hashes(hashes)
                low = least.astype(np.uint8).tobytes()
                mixed = place
                for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                    mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                bands = mixed.view(np.int64)
            rows.append((hashlib.sha256(b" ".join(words)).digest(), np.uint64(print_of(hashes)).view(np.int64), len(hashes), low, bands))
        key, fp, n, low, bands = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_sha256", "key", "fp", "n", "low", "bands"])


def _degrees(pairs: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    """(uid, columns, n_a, n_b): the units of the written pairs (a, b), and in how many they stand on either side."""
    sides = pairs.select(F.col("a").alias("uid"), F.lit(1).alias("n_a"), F.lit(0).alias("n_b")).union(pairs.select("b", F.lit(0), F.lit(1)))
    counted = written(sides.groupBy("uid").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")), "degrees", narrow=True)
    return written(attach(units.select("uid", *columns), counted, ["uid"], "inner"), "involved", narrow=True)


def _both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with a column of facts (uid, column, n_a, n_b) for either side."""
    for side in ("a", "b"):
        pairs = attach(pairs, facts.select(F.col("uid").alias(side), F.col(column).alias(f"{column}_{side}"), f"n_{side}"), [side], "inner", f"n_{side}").drop(f"n_{side}")
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _likely(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) of uids that have enough equal hashes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= EQUAL[-1]))

    return _both(pairs, _degrees(pairs, units, "low"), "low").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, units: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose texts have an exact Jaccard similarity of JACCARD; docs: (sha, text)."""
    involved = _degrees(pairs, units, "sha")
    texts = attach(docs, involved, ["sha"], "inner").groupBy("uid").agg(F.first("text").alias("text"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set[bytes]] = {}
        held = 0

        def shingles(text: bytes) -> set[bytes]:
            nonlocal held
            if text not in known:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                known[text] = shingle_set(text)
                held += len(text)
            return known[text]

        for batch in slices(batches):
            texts = [batch.column(k).cast(pa.large_binary()) for k in (2, 3)]
            keep = [similar(*(shingles(t[i].as_buffer().to_pybytes()) for t in texts)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, written(texts, "texts"), "text").mapInArrow(check, "a long, b long")


class _Groups:
    """Verified links so far and the components that they make: comps (uid, comp) of linked units, no other."""

    def __init__(self, units: DataFrame, docs: DataFrame):
        self.units, self.docs = units, docs
        self.edges = units.sparkSession.createDataFrame([], "a long, b long")
        self.comps = units.sparkSession.createDataFrame([], "uid long, comp long")
        self.tested = self.edges

    def add(self, pairs: DataFrame, name: str, likely: bool = False) -> None:
        """Verify the pairs (a < b) that were not tested before; ``likely``: their hashes have been compared."""
        pairs = written(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), f"{name}-pairs", narrow=True)
        self.tested = self.tested.union(pairs)
        if not likely:
            pairs = written(_likely(pairs, self.units), f"{name}-likely", narrow=True)
        if pairs.isEmpty():
            return
        found = written(_verified(pairs, self.units, self.docs), f"{name}-verified", narrow=True)
        if found.isEmpty():
            return
        self.edges = written(self.edges.union(found), "edges", narrow=True)
        self.comps = written(components(self.edges).select(F.col("node").alias("uid"), F.col("root").alias("comp")), "comps", narrow=True)

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows (with uid) and comp, the uid itself where nothing is linked."""
        return attach(rows, self.comps, ["uid"], "left").withColumn("comp", F.coalesce("comp", "uid"))


def _inside(least: int):
    """A function of batches of rows that stand together by key: the pairs inside groups with ``least`` or more equal hashes.

    Both are of different components and not in a group of an earlier band that is compared too (``large`` has a bit for
    each band whose group is not).
    """
    names = ["a", "b"]

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid, fp, n, comp, band, large = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "fp", "n", "comp", "band", "large"))
        low, fp = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(len(uid), HASHES), fp.view(np.uint64)
        bands = rows.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(uid), BANDS)
        for i in range(len(uid) - 1):
            j = np.flatnonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= APART) & (comp[i + 1 :] != comp[i])) + i + 1
            j = j[np.minimum(n[j], n[i]) * JACCARD[1] >= np.maximum(n[j], n[i]) * JACCARD[0]]
            j = j[(low[j] == low[i]).sum(axis=1) >= least]
            before = [k for k in range(band[i]) if not large[i] >> k & 1]
            if len(j) and before:
                j = j[~(bands[j][:, before] == bands[i][before]).any(axis=1)]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[j], uid[i])), pa.array(np.maximum(uid[j], uid[i]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            key = rows.column("key").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            for begin, end in zip([0, *cuts], cuts, strict=False):
                yield from pairs(rows.slice(begin, end - begin))
            rest = rows.slice(cuts[-1] if cuts else 0)
        if rest is not None:
            yield from pairs(rest)

    return run


def _fits(x: str, y: str) -> str:
    return f"bit_count({x}.fp ^ {y}.fp) <= {APART} and least({x}.n, {y}.n) * {JACCARD[1]} >= greatest({x}.n, {y}.n) * {JACCARD[0]}"


def link_by_bands(groups: _Groups, close: DataFrame) -> None:
    """Add the links of all units that share a band to ``groups``, and those of the pairs ``close`` (a, b)."""
    units = groups.units
    facts = units.select("uid", "fp", "n")
    rows = units.select("uid", F.posexplode("bands").alias("band", "key"))
    level = 0
    while True:
        leader = F.min_by("uid", F.xxhash64("uid", F.lit(level))).alias("leader")
        heads = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), leader).filter("size > 1"), "heads", narrow=True)
        rows = written(attach(rows, heads, ["key"], "inner", "size"), "members", narrow=True)
        if rows.isEmpty():
            return groups.add(close, "close") if level == 0 else None
        led = written(attach(rows.select(F.col("leader").alias("uid"), F.col("uid").alias("b")).filter("uid <> b").distinct(), facts, ["uid"], "inner").select(F.struct("uid", "fp", "n").alias("x"), F.col("b").alias("uid")), "led", narrow=True)
        stars = attach(led, facts, ["uid"], "inner").select("x", F.struct("uid", "fp", "n").alias("y")).filter(_fits("x", "y"))
        stars = stars.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))
        groups.add(stars.union(close) if level == 0 else stars, f"stars-{level}")
        facts_of = rows.select("uid", "band", "key", "size")
        masks = written(facts_of.filter(F.col("size") > LEAF).groupBy("uid").agg(F.expr("bit_or(shiftleft(1L, band))").alias("large")), "masks", narrow=True)
        for least in EQUAL:  # what is surely near first, so that the rest need not be compared where that has joined it
            marked = written(groups.mark(facts_of), "marked", narrow=True)
            mixed = written(marked.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key", "weight"), "mixed", narrow=True)
            open_ = attach(attach(marked, mixed, ["key"], "inner", "weight").drop("weight"), masks, ["uid"], "left")
            open_ = open_.withColumn("large", F.coalesce("large", F.lit(0).cast("long")) if level == 0 else F.lit(-1).cast("long"))
            rest = written(attach(open_, units.select("uid", "fp", "n", "low", "bands"), ["uid"], "inner"), "rest", narrow=True)
            near = rest.filter(F.col("size") <= LEAF).select("key", "band", "uid", "fp", "n", "comp", "low", "bands", "large")
            groups.add(near.repartition("key").sortWithinPartitions("key").mapInArrow(_inside(least), "a long, b long"), f"pairs-{level}", likely=True)
        large = rest.filter(F.col("size") > LEAF)
        rows = large.select("uid", "key", "band", F.posexplode("bands").alias("next", "value")).filter("next > band").select("uid", F.col("next").alias("band"), F.xxhash64("key", "value").alias("key"))
        level += 1


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the rows of docs that go when each group keeps one survivor.

    A group is what links of an exact five-word Jaccard similarity of 0.8 or more hold together. The survivor has the
    least doc_id (of any type with an order), a null id comes last, equal ids are told apart by the text's digest; rows
    with the same id and text stay or go together. Null texts count as empty; all texts without words are one group.
    Other columns, whatever their names, are not looked at. Empty input gives an empty result. Of a very long text one
    task holds the shingles.
    """
    source = docs.select("doc_id", F.sha2(whole_text(), 256).alias("sha"), whole_text().alias("text"))
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("text_sha256", StringType()), StructField("key", BinaryType()), StructField("fp", LongType()), StructField("n", LongType()), StructField("low", BinaryType()), StructField("bands", ArrayType(LongType()))])
    rows = written(source.mapInArrow(_units, schema), "rows")
    first = F.min_by(F.struct("doc_id", "text_sha256"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256"))
    units = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("fp", "n", "low", "bands")], F.min("text_sha256").alias("sha"), first.alias("best"), F.count(F.lit(1)).alias("size"))
    units = written(units.withColumn("uid", F.monotonically_increasing_id()), "units")
    groups = _Groups(units, source.select("sha", "text"))
    prints = written(units.filter("n > 0").groupBy("fp").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("held")), "prints", narrow=True)
    links = written(hamming_links(prints, prints.count(), RADIUS), "links", narrow=True)
    for side in ("a", "b"):
        links = attach(links.withColumnRenamed(side, "fp"), prints.select("fp", F.col("uid").alias(f"uid_{side}")), ["fp"], "inner").drop("fp")
    same = attach(units.filter("n > 0").select("uid", "fp"), prints.filter("held > 1").select("fp", F.col("uid").alias("a"), "held"), ["fp"], "inner", "held").filter("a <> uid").select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b"))
    near = links.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b"))
    link_by_bands(groups, near.union(same))
    now = written(groups.mark(units.select("uid", "key", "best", "size")), "grouped", narrow=True)
    least = F.min_by("best", F.struct(F.col("best.doc_id").isNull(), F.col("best.doc_id"), F.col("best.text_sha256")))
    best = written(now.groupBy("comp").agg(least.alias("stays"), F.count(F.lit(1)).alias("weight")), "best", narrow=True)
    labels = written(attach(now.select("key", "comp", "size"), best, ["comp"], "left", "weight").select("key", "stays", "size"), "labels", narrow=True)
    out = attach(rows.select("doc_id", "text_sha256", "key"), labels, ["key"], "left", "size")
    return out.filter(~F.struct("doc_id", "text_sha256").eqNullSafe(F.col("stays"))).select("doc_id", "text_sha256")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one survivor of each group of ``near_copies``; all columns are kept as they are."""
    return without(docs, near_copies(docs.select("doc_id", "text")))
