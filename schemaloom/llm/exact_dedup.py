"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints, cut into blocks by quotient.
The filters of a block meet in one task, which merges their sorted remainders without loss. Only texts whose
fingerprint was counted more than once go on to byte verification: a partial aggregation by the text itself, so
that a group of copies of any size moves once for each map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import NUMBERS, attach, every, fresh, id_text, table, whole_text, without, written

#: Fingerprints that a block of the merged filter holds on average.
BLOCK_FINGERPRINTS = 1 << 19
#: Fingerprints gathered by a map task before it emits its filter.
FILTER_FINGERPRINTS = 1 << 20


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints that share their first ``block_bits`` bits.

    A fingerprint's next ``q_bits`` bits are its quotient, the rest its remainder. Remainders stand in runs by
    quotient, sorted within a run; a bit for each quotient says whether it has a run, a bit for each slot whether it
    ends one. Counts of one take no room: a bit for each slot says whether it has a counter. Counters are as wide as
    the greatest of the filter needs, up to 64 bits, so none wraps. As no bit of a fingerprint is given up, merging
    loses nothing, whatever the sizes of the filters.
    """

    def __init__(self, block: int, block_bits: int, fingerprints: np.ndarray, counts: np.ndarray):
        self.block, self.block_bits = block, block_bits
        n = len(fingerprints)
        self.q_bits = min(max(1, int(n).bit_length()), 24)
        shift = np.uint64(64 - block_bits - self.q_bits)
        local = fingerprints & np.uint64((1 << (64 - block_bits)) - 1)
        quotient = local >> shift
        self.remainders = local & ((np.uint64(1) << shift) - np.uint64(1))
        self.occupied = np.zeros(1 << self.q_bits, bool)
        self.occupied[quotient] = True
        self.run_end = np.ones(n, bool)
        self.run_end[:-1] = quotient[1:] != quotient[:-1]
        self.counted = counts > 1
        self.counters = counts[self.counted].astype(np.int64)

    @classmethod
    def of(cls, block: int, block_bits: int, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        sorted_, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, int)
        return cls(block, block_bits, sorted_[first], np.add.reduceat(counts, first) if len(first) else counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        shift = np.uint64(64 - self.block_bits - self.q_bits)
        run = np.cumsum(np.r_[0, self.run_end[:-1]]) if len(self.run_end) else np.zeros(0, int)
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        top = np.uint64(self.block) << np.uint64(64 - self.block_bits) if self.block_bits else np.uint64(0)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.counted] = self.counters
        return top | (quotient << shift) | self.remainders, counts

    def to_bytes(self) -> bytes:
        width = next(w for w in (1, 2, 4, 8) if not len(self.counters) or int(self.counters.max()) >> (8 * w - 1) == 0)
        head = np.array([self.block, self.block_bits, self.q_bits, len(self.remainders), len(self.counters), width], np.int64)
        return b"".join((head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), np.packbits(self.counted).tobytes(), self.remainders.astype(np.uint64).tobytes(), self.counters.astype(f"<i{width}").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        block, block_bits, q_bits, n, m, width = np.frombuffer(data, np.int64, 6).tolist()
        self.block, self.block_bits, self.q_bits, at = block, block_bits, q_bits, 48

        def bits(k: int) -> np.ndarray:
            nonlocal at
            size = (k + 7) // 8
            out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=k).astype(bool)
            at += size
            return out

        self.occupied, self.run_end, self.counted = bits(1 << q_bits), bits(n), bits(n)
        self.remainders = np.frombuffer(data, np.uint64, n, at)
        self.counters = np.frombuffer(data, f"<i{width}", m, at + 8 * n).astype(np.int64)
        return self

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all: two by two their runs are merged in the order of quotient and remainder, equal ones add up."""
        parts = [f.items() for f in filters]
        while len(parts) > 1:
            parts = [merge_sorted(*parts[i], *parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return cls(filters[0].block, filters[0].block_bits, *parts[0])


def merge_sorted(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of two ascending lists of different values, whose counts n and m are added."""
    if len(a) < len(b):
        a, n, b, m = b, m, a, n
    at = np.searchsorted(a, b)
    both = at < len(a)
    both[both] = a[at[both]] == b[both]
    n = n.copy()
    n[at[both]] += m[both]
    place = at[~both] + np.arange(np.count_nonzero(~both))
    old = np.ones(len(a) + len(place), bool)
    old[place] = False
    values, counts = np.empty(len(old), a.dtype), np.empty(len(old), n.dtype)
    values[old], values[place], counts[old], counts[place] = a, b[~both], n, m[~both]
    return values, counts


def _filters(block_bits: int):
    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        fingerprints = np.sort(np.concatenate(parts))
        blocks = (fingerprints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fingerprints), np.int64)
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        rows = [(int(blocks[a]), CountingQuotientFilter.of(int(blocks[a]), block_bits, fingerprints[a:b]).to_bytes()) for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                n += batch.num_rows
            if n >= FILTER_FINGERPRINTS:
                yield emit(parts)
                parts, n = [], 0
        if n:
            yield emit(parts)

    return run


def _repeated(block: pa.Table) -> pa.Table:
    fingerprints, counts = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in block.column("filter").to_pylist()]).items()
    more = counts > 1
    return pa.table({"fp": pa.array(fingerprints[more].view(np.int64)), "n": pa.array(counts[more])})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the values of the one long column of ``fingerprints`` that occur more than once; rows: how many there are, about."""
    block_bits = max(4, (max(rows, 1) // BLOCK_FINGERPRINTS).bit_length())
    return fingerprints.mapInArrow(_filters(block_bits), "block int, filter binary").groupBy("block").applyInArrow(_repeated, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays. A null id never
    wins over another; if all ids of a group are null, keep_id is null and kept is true. Rows that repeat the id as
    well as the text are one document given twice: both count in group_size and have the same decision. Empty input
    gives an empty result; other columns of docs are not looked at and not returned. Very long texts are never held
    in Python: only their fingerprints are.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("fp"))
    repeated = written(repeated_fingerprints(rows.select("fp"), rows.count()), "fingerprints", narrow=True)
    groups = (
        attach(rows, repeated.filter("n > 1"), ["fp"], "inner", "n", NUMBERS)  # the condition lets Spark put a Bloom filter of its own before the shuffle of texts
        .groupBy("fp", "_text")  # the bytes themselves are compared here
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("fp", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = written(groups, "groups", narrow=True)
    narrow = rows.select("doc_id", "fp", F.sha2("_text", 256).alias("text_sha256"))
    joined = attach(narrow, groups, ["fp", "text_sha256"], "left", "group_size")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("doc_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest doc_id; of rows that repeat id and text one stays.

    docs needs doc_id (of any type with an order) and text; all columns are kept as they are, whatever their names. Null
    texts count as empty, so of null and empty texts one row stays. Empty input gives an empty result.
    """
    found = exact_dedup(docs.select("doc_id", "text"))
    out = without(docs, found.filter(~F.col("kept")))
    key, sha, n = fresh("key", docs), fresh("sha", docs), fresh("n", docs)
    again = found.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = written(again.select(id_text().alias(key), F.col("text_sha256").alias(sha), F.col("n").alias(n)), "repeated", narrow=True)
    if again.isEmpty():
        return out
    keyed = out.withColumns({key: id_text(), sha: F.sha2(whole_text(), 256)})
    one = attach(keyed, again, [key, sha], "inner", n).groupBy(key, sha).agg(F.first(F.struct(*every(docs))).alias("row")).select("row.*")
    return attach(keyed, again, [key, sha], "left_anti", n).select(*every(docs)).unionByName(one)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
