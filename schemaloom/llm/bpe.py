"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix ends with exactly one token. An automaton over the vocabulary finds the tokens that end at
each place; a token is the last one of that prefix if it and the last token of the prefix before it may stand side by
side, that is if undoing their merges meets no pair across their border that would have been merged earlier. Following
the last tokens backwards gives the ids. Work is linear in the text for a given vocabulary.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import slices, table, whole_text

#: The split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words that a worker remembers in each of two generations (when the newer is full it becomes the older, and words met again move on), and pairs of tokens, which start anew.
WORDS, PAIRS, LONGEST_WORD = 250_000, 300_000, 48
#: The same where the encoder shares its workers with other stages.
FEW_WORDS = 30_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Encoder and decoder for a tokenizer file of the ``tokenizers`` library: byte-level BPE without normaliser."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE is supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        byte = byte_alphabet()
        as_bytes = {t: bytes(map(byte.__getitem__, t)) for t in model["vocab"]}
        self.bytes_of = {i: as_bytes[t] for t, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        self.pair_rank: dict[tuple[int, int], int] = {}
        size = max(self.bytes_of) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        vocab = model["vocab"]
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            if (ia, ib) not in self.pair_rank:
                self.pair_rank[ia, ib] = rank
                if self.rank[ic] < 0:
                    self.left[ic], self.right[ic], self.rank[ic] = ia, ib, rank
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, tuple[int, ...]] = {}
        for t, i in vocab.items():
            word = as_bytes[t].decode("latin-1")
            if len(word) == 1 or self.rank[i] >= 0 and self._stands(self.left[i], self.right[i], self.rank[i]):
                self.automaton.add_word(word, (i, len(word)))
                self.whole[word] = (i,)
        self.automaton.make_automaton()
        self.table = [self.bytes_of.get(i, b"") for i in range(size)]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: int | None = None

    def _stands(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no pair across the border of tokens a and b merges before ``limit``."""
        left, right, rank, pair = self.left, self.right, self.rank, self.pair_rank
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:  # a was made later: undo it; a pair of the same rank further right comes after it
                a, limit = right[a], ra
            elif rb < 0:
                return True
            else:  # a pair of the same rank further left comes before it
                b, limit = left[b], rb + 1

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece of the split; its bytes as latin-1."""
        if word in self.whole:
            return self.whole[word]
        last, pairs = [-1] * (len(word) + 1), self.pairs
        for at, (token, n) in self.automaton.iter(word):
            if last[at + 1] >= 0:
                continue
            begin = at + 1 - n
            if begin:
                key = last[begin] << 20 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self._stands(last[begin], token)
                if not ok:
                    continue
            last[at + 1] = token
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return tuple(reversed(ids))

    def _unmet(self, piece: str) -> bytes:
        """Ids, as int32, of a piece that the newer generation lacks."""
        ids = self.words.get(piece) or self.older.get(piece) or array("i", self._word(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= LONGEST_WORD:
            if len(self.words) >= (self.kept or WORDS):
                self.words, self.older = {}, self.words
            self.words[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = self.split.findall(text)
        found = list(map(self.words.get, pieces))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self._unmet(pieces[at])
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        """The ids as int32."""
        if self.split_added is None or not any(x in text for x in self.added):
            return np.frombuffer(self._plain(text), np.int32)
        parts = [array("i", [self.added[x]]).tobytes() if x in self.added else self._plain(x) for x in self.split_added.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(key: str, spec: str) -> Bpe:
    """The encoder of a worker process, built once."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(json.loads(spec))
    return _loaded[key]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_roundtrip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, words: int | None = None) -> DataFrame:
    """One row for each row of docs: id, ids array<int>, decoded string (left out without ``decode``).

    Whole texts are encoded; null counts as empty and has no ids. ``tokenizer``: path of a tokenizer file, read on the
    driver and broadcast (a few MB, whatever the data); ``words``: how many words a worker remembers in each generation,
    if not WORDS. Rows are independent: no shuffle; repeated rows give repeated results, empty input an empty one. Other
    columns, whatever their names, are not looked at. A very long text is one Python object at a time.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, spec.value)
        bpe.kept = words
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
            if decode:
                columns.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])
        if words is not None:  # the worker lives on with other stages
            _loaded.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids, joined by commas, and of the decoded text."""
    out = bpe_roundtrip(docs, words=words)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
