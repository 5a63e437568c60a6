"""Importance resampling against a plain walk, with n-grams, ties, nulls, repeats, empties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from schemaloom.llm import importance as I


def features(text, ngrams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, ngrams=I.NGRAMS, buckets=I.BUCKETS, least=I.LEAST, percent=I.PERCENT, seed=I.SEED):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in features(x, ngrams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        n, each = features(x, ngrams)
        weight = sum(gain(bucket(f)) for f in each)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(order[: len(order) * percent // 100])}
    return Counter((*x[:4], rank.get(id(x))) for x in out)


def frame(spark, rows, schema="doc_id long, text string, row int, rank int, `a.b` int, weight string, part int"):
    return spark.createDataFrame([(i, t, 7, 1, 1, "w", 3) for i, t in rows], schema)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "Ünder", "été", "x1", "日本", "delta's", "e-mail", "zz"]
    return ["; ".join(rng.choices(words, k=rng.choice((0, 1, 5, 19, 20, 30, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("ngrams", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (2, 50, 5, 60), (3, 7, 1, 100)])
def test_against_a_plain_walk(spark, ngrams, buckets, least, percent):
    docs = [(i, t) for i, t in enumerate(texts(1, 300))] + [(900, None), (901, ""), (902, "..."), (903, "word " * 30000)]
    target = [*texts(2, 20), None, ""]
    got = I.resampled(frame(spark, docs).repartition(6), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), ngrams, buckets, least, percent)
    assert found(got) == plain(docs, target, ngrams, buckets, least, percent)


def test_ties_nulls_repeats_and_empty_tables(spark):
    same = "one two three four five six"
    docs = [(None, same), (None, same), (3, same), (3, same), (1, "other words stand in this text")] * 2
    target = spark.createDataFrame([(same,)], "text string")
    got = I.resampled(frame(spark, docs), target, least=1, percent=50)
    assert found(got) == plain(docs, [same], least=1, percent=50)
    none = spark.createDataFrame([], "text string")
    assert found(I.resampled(frame(spark, docs), none, least=1)) == plain(docs, [], least=1)
    assert I.resampled(frame(spark, []), target).count() == 0
    kept = I.drawn_documents(frame(spark, docs), target, least=1, percent=100)
    assert kept.count() == 10 and kept.columns == frame(spark, []).columns


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 37 as score")
    got = sorted(I.ranked(rows, rows.score.desc(), rows.id).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 5001)) and [(r.score, r.id) for r in got] == sorted(((i % 37, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
