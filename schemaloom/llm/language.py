"""Language identification by nearest centroids.

A text becomes a unit vector of hashed character n-grams, weighted by TF-IDF. Every language has several centroids, found
by spherical k-means on a bounded sample of its labelled texts; a text gets the language of the centroid with the greatest
cosine. It is rejected if it is farther from that centroid than nearly all texts of the language's sample that have about
as many n-grams were from their own: the cosine grows with the length, so every band of lengths has its own bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from schemaloom.llm._common import SLICE, attach, every, fresh, slices, table, whole_text, written

#: Buckets of hashed n-grams, and their lengths in characters.
BUCKETS, GRAMS = 1 << 13, (1, 2, 3)
#: Texts of each language that the centroids are fitted on (expected; drawn by hash), centroids of a language, rounds of k-means.
SAMPLE, CENTROIDS, ROUNDS = 1500, 4, 8
#: Where bands of n-gram counts begin anew, the quantile of the sample's cosines in a band that is the bound of rejection, and
#: the texts that a language must have in a band for a bound of its own; with fewer the band's texts of all languages count.
BANDS, LOW, OWN = (128, 512, 2048), 0.002, 200
#: What a cosine may lose by the order of float32 sums.
ROUNDING = 1e-4
#: An n-gram counts as no rarer than in this share of the texts, or chance n-grams would outweigh all others in short texts.
RAREST = 0.05
UNKNOWN = "und"

_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter; built once in a worker."""
    global _lower
    if _lower is None:
        found = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                found[i] = ord(low) if len(low) == 1 else i
        _lower = found
    return _lower


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text; gaps between words count as one space. None if no letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points > 0
    if not keep.any():
        return None
    keep[1:] |= points[:-1] > 0  # the first of a gap stands for it
    points = np.concatenate(([np.uint32(0)], points[keep], [np.uint32(0)])).astype(np.uint64)
    codes, out = np.zeros(len(points), np.uint64), []
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            break
        codes = codes[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            out.append(((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64))
    return np.bincount(np.concatenate(out), minlength=buckets)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors of the texts, and how many n-grams these have; both are zero without letters."""
    out, grams = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        counts = ngram_counts(t, len(idf)) if t else None
        if counts is not None:
            row = np.log1p(counts.astype(np.float32)) * idf
            length = float(np.sqrt(row @ row))
            if length:
                out[i] = row / length
            grams[i] = counts.sum()
    return out, grams


def kmeans(points: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each point's cosine to the nearest; starts from points that are far apart."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(k, len(points)):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-6:
            break
        chosen.append(at)
        near = np.maximum(near, points @ points[at])
    centroids = points[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centroids.T, axis=1)
        for c in range(len(centroids)):
            total = points[own == c].sum(axis=0)
            if (length := float(np.sqrt(total @ total))) > 0:
                centroids[c] = total / length
    return centroids, (points @ centroids.T).max(axis=1)


def band(grams: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, grams, side="right")


def expected(grams: np.ndarray) -> np.ndarray:
    """What a bound is multiplied by: within the first band a text's cosine grows as the root of its n-grams."""
    return np.sqrt(np.minimum(grams, BANDS[0]) / BANDS[0])


def bounds(cosines: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
    """The least cosine that is not rejected, as a multiple of ``expected``, for each language (rows) and band, from the cosines and n-gram counts of its sample."""
    out = np.zeros((len(cosines), len(BANDS) + 1), np.float32)
    if not cosines:
        return out
    cosines = [x / expected(n) for x, n in zip(cosines, grams, strict=True)]
    every, bands = np.concatenate(cosines), band(np.concatenate(grams))
    for b in range(len(BANDS) + 1):
        pool = every[bands == b] if (bands == b).any() else every
        for i, (x, n) in enumerate(zip(cosines, grams, strict=True)):
            own = x[band(n) == b]
            out[i, b] = np.quantile(own if len(own) >= OWN else pool, LOW, method="lower") - ROUNDING
    return out


class LanguageModel:
    """Centroids (rows), their languages and bounds of rejection by band, and the weights of the buckets."""

    def __init__(self, languages: list[str], centroids: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.least, self.idf = languages, centroids, least, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine to the nearest centroid, 0 to 1) and whether the text is rejected."""
        points, grams = vectors(texts, self.idf)
        known = grams > 0
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = points @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), ~known | (score < self.least[best, band(grams)] * expected(grams))


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """A model from ``labelled`` (doc_id, text, lang); rows whose lang is null are left out.

    The weights of n-grams come from all labelled rows. The centroids are fitted on about ``sample`` rows of each
    language, drawn by a hash of id and text (rows that repeat both are drawn together), so what reaches one task or the
    driver grows with the number of languages only. Null texts and texts without letters teach nothing; without any
    labelled row the model rejects everything.
    """
    rows = labelled.filter(F.col("lang").isNotNull()).select("doc_id", whole_text().alias("text"), "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text) if text else None
                if counts is not None:
                    found += counts > 0
                    docs += 1
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.concatenate(([docs], found)))], ["bucket", "n"])

    counted = dict(map(tuple, rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()))
    docs = counted.get(-1, 0)
    idf = np.array([np.log((1 + docs) / (1 + max(counted.get(i, 0), RAREST * docs))) + 0.1 for i in range(BUCKETS)], np.float32)
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages", narrow=True)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = attach(rows, sizes, ["lang"], "inner", "n").filter(share < F.lit(float(sample)) / F.col("n")).select("lang", "text")

    def clusters(group: pa.Table) -> pa.Table:
        parts = [vectors(group.column("text").slice(at, SLICE).to_pylist(), idf) for at in range(0, group.num_rows, SLICE)]
        points, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
        points, grams = points[grams > 0], grams[grams > 0]
        order = np.lexsort((points[:, 1], points[:, 0]))
        found, cosines = kmeans(points[order], centroids, ROUNDS) if len(points) else ([], [])
        shown = [cosines, *[[]] * (len(found) - 1)] if len(found) else []  # the language's sample stands with its first centroid
        sizes = [grams[order], *[[]] * (len(found) - 1)] if len(found) else []
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(found), pa.string()), "k": pa.array(range(len(found)), pa.int32()), "centroid": pa.array(list(found), pa.list_(pa.float32())), "cosines": pa.array(shown, pa.list_(pa.float32())), "grams": pa.array(sizes, pa.list_(pa.int64()))})

    found = drawn.groupBy("lang").applyInArrow(clusters, "lang string, k int, centroid array<float>, cosines array<float>, grams array<long>").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    matrix = np.array([r[2] for r in found], np.float32).reshape(-1, BUCKETS)
    heads = [r for r in found if r[1] == 0]
    least = bounds([np.array(r[3], np.float32) for r in heads], [np.array(r[4], np.int64) for r in heads])
    row = {r[0]: i for i, r in enumerate(heads)}
    return LanguageModel([r[0] for r in found], matrix, least[[row[r[0]] for r in found]], idf)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced, all others kept, whatever their names.

    lang_pred is ``und`` if the text is null or has no letter; such rows are rejected too. A rejected text with letters
    still has its nearest language. Rows are independent, so repeated rows get repeated results and an empty input an
    empty one. A very long text is one Python object at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "rejected")
    text = text_col
    if text_col in added:
        text = fresh("text", docs)
        docs = docs.withColumn(text, F.col(text_col))
    docs = docs.drop(*added)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, rejected = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [f.name for f in schema])

    out = docs.mapInArrow(run, schema)
    return out if text == text_col else out.drop(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: the CRC-32 of its id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame) -> LanguageModel:
    """The model of the documents that are not held out; a null id is not held out."""
    return fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))


def with_known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows that the model of all their labels rejects; all columns are kept as they are.

    Null texts and texts without letters go. So does about the share LOW of each language's own texts, the least alike of each
    length: that is the price of a bound taken from the languages themselves. Rows are judged each for itself, so repeated rows
    stay or go together; a text as near to two languages as to one stays. Without labels all rows go; an empty table stays empty.
    """
    others = docs.drop("text")
    rows = docs.select(F.struct(*every(others)).alias("row"), "text")
    known = identify(rows, fit(docs.select("doc_id", "text", "lang"))).filter(~F.col("rejected"))
    return known.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit_on(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language": op2_language}
ORACLE: dict[str, str] = {}
