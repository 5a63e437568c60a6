"""Toxicity by a classifier chain.

The labels give three categories: toxic, low quality, and both at once. They are predicted in that order by logistic
models over word presence and a few measures of style; each later model also gets the probabilities of the earlier ones.
In training these are out-of-fold predictions, so a later model meets them as they will be on texts not seen before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import slices, table, whole_text, written

#: The chain's categories, each from the columns toxic and quality of the labels.
CATEGORIES = {"toxic": "toxic = 1", "low_quality": "quality = 0", "toxic_low_quality": "toxic = 1 and quality = 0"}
#: Labelled documents that the models are fitted on (expected; drawn by hash), words kept for each category, folds.
SAMPLE, WORDS, FOLDS = 12_000, 120, 3
#: Least labelled documents that a word must occur in, the weight of the squared coefficients, rounds of Newton's method.
LEAST, PENALTY, ROUNDS = 4, 0.3, 12
#: A document is toxic from this probability on.
THRESHOLD = 0.5

#: Lengths of the beginnings of words that are features beside the whole words, so that inflected and compound forms count.
STEMS = (4, 5, 6, 7, 8)

_token = regex.compile(r"\p{L}+|[^\p{L}\p{N}\p{White_Space}]{2,}")


def words(text: str) -> set[str]:
    """Distinct words in lower case, their beginnings (marked with a hyphen), and runs of signs."""
    whole = set(_token.findall(text.lower()))
    out = set(whole)
    for n in STEMS:
        out.update([w[:n] + "-" for w in whole if len(w) >= n])
    return out


def style(text: str) -> list[float]:
    """Shares of capitals, digits and signs, the share of distinct words, and the length."""
    n = max(len(text), 1)
    parts = text.split()
    alpha, digit, space = sum(map(str.isupper, text)), sum(map(str.isdigit, text)), sum(map(str.isspace, text))
    letters = sum(map(str.isalpha, text))
    return [alpha / n, digit / n, (n - letters - digit - space) / n, len(set(parts)) / max(len(parts), 1), np.log1p(n) / 10]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Coefficients, the last one free of penalty for the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The vocabulary and a logistic model for each category, in order."""

    def __init__(self, vocabulary: list[str], categories: list[str]):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.categories, self.models = categories, []

    def features(self, texts: list[str]) -> np.ndarray:
        known, n = self.place.keys(), len(self.place)
        x = np.zeros((len(texts), n + 5), np.float32)
        for i, t in enumerate(texts):
            x[i, [self.place[w] for w in known & words(t)]] = 1
            x[i, n:] = style(t)
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        """y: a column for each category; fold: the fold of each row."""
        x = x.astype(np.float64)
        for j in range(y.shape[1]):
            unseen = np.zeros(len(x))
            for f in np.unique(fold):
                train = fold != f if (fold != f).any() else fold == f
                unseen[fold == f] = _chance(x[fold == f], logistic(x[train], y[train, j]))
            self.models.append(logistic(x, y[:, j]))
            x = np.hstack([x, unseen[:, None]])
        return self

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, a column for each category."""
        x, out = self.features(texts).astype(np.float64), []
        for w in self.models:
            out.append(_chance(x, w))
            x = np.hstack([x, out[-1][:, None]])
        return np.array(out).T if out else np.zeros((len(texts), len(self.categories)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain from about ``sample`` labelled documents (doc_id, text; doc_id, toxic, quality), all of them if there are fewer.

    Several labels of a document count as toxic if one says so and as of quality if all say so; null labels are left out.
    Of rows that repeat a drawn id one is learned from, that with the least hash of its text, so what reaches the driver is a
    row for each drawn id: about ``sample``, as ids are drawn by hash. Without labelled documents all probabilities are 0.
    """
    names = list(CATEGORIES)
    labels = labels.filter("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, labels.count()))
    drawn = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) < share)
    drawn = drawn.select("doc_id", *[F.expr(f"cast({CATEGORIES[c]} as int)").alias(c) for c in names])
    each = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", *names), F.xxhash64("text")).alias("x"))
    train = written(each.select("x.*", F.pmod(F.xxhash64("x.text"), F.lit(FOLDS)).cast("int").alias("fold")), "train")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            marks = np.array([batch.column(1 + j).to_pylist() for j in range(len(names))], np.int64).T
            for text, mark in zip(batch.column(0).to_pylist(), marks, strict=True):
                one = np.concatenate(([1], mark))
                for w in words(text) | {""}:
                    if w in found:
                        found[w] += one
                    else:
                        found[w] = one.copy()
        if found:
            counts = np.array(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *[pa.array(counts[:, j]) for j in range(counts.shape[1])]], ["word", "n", *names])

    counted = train.select("text", *names).mapInArrow(occurrences, "word string, n long, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    counted = counted.persist()
    total = counted.filter("word = ''").first()
    if total is None:
        return Chain([], names)
    often, docs_n = counted.filter(f"word <> '' and n >= {LEAST}"), total["n"]
    vocabulary: set[str] = set()
    for c in names:
        rate = total[c] / docs_n
        z = F.abs(F.col(c) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate) + 1e-9))
        vocabulary |= {r[0] for r in often.orderBy(z.desc(), "word").limit(WORDS).select("word").collect()}
    counted.unpersist()
    chain = Chain(sorted(vocabulary), names)
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = held.value.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), *batch.columns[1:]], ["x", *names, "fold"])

    got = train.mapInArrow(rows, "x binary, " + ", ".join(f"{c} int" for c in names) + ", fold int").toPandas().sort_values(["fold", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), -1).astype(np.float32)
    return chain.fit(x, got[names].to_numpy(np.float64), got["fold"].to_numpy())


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, p_<category> for each category, toxic (p_toxic is THRESHOLD or more, so a tie is toxic).

    Null texts count as empty. Rows are independent, so repeated rows get repeated results and empty input an empty one.
    Other columns, whatever their names, are not looked at. A very long text is one Python object at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = held.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])]], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.select(F.col("id").alias(id_col), *names, (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
