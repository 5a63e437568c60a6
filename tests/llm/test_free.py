"""WARC, BPE, token counts, SimHash, exact dedup, language, toxicity: round trips, brute force and held-out accuracy."""

import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.llm import bpe as B
from schemaloom.llm import exact_dedup as E
from schemaloom.llm import language as L
from schemaloom.llm import near_copies as N
from schemaloom.llm import simhash as H
from schemaloom.llm import token_counts as C
from schemaloom.llm import toxicity as T
from schemaloom.llm import warc as W
from schemaloom.llm.components import components

DOCS = "doc_id long, text string, fp long, keep_id string, lang string, n_tokens int"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", "en", 1) for i, t in rows], DOCS)


ODD = ["", None, " ", "\n\t", "a", "naïve café — 东京 😀", "x" * 30000, "1 2 3 4", "<|endoftext|> and <|endoftext|>", "don't we'll I'M", "  z 　", "ẹ́", "½ ² Ⅷ १२", "\r\n\r\n  end  "]

# WARC


def page(i, body, **more):
    return W.page_record(f"urn:page:{i}", f"http://x/{i}", body, more.get("refers_to"), "2024-01-01T00:00:00Z")


def test_records_round_trip_in_small_chunks(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 7)
    bodies = [b"", b"a", "é😀".encode() * 100, bytes(range(256)) * 50, b"\r\n\r\n" * 9]
    data = b"".join(page(i, x) for i, x in enumerate(bodies)) + page(9, bodies[2], refers_to="urn:page:2")
    members = W._Members
    monkeypatch.setattr(W, "_Members", lambda stream: members(stream, 7))
    got = list(W.read_records(io.BytesIO(data), payloads=True))
    assert [x["payload"] for x in got[:5]] == bodies
    assert [x["payload_bytes"] for x in got] == [*map(len, bodies), len(bodies[2])]
    assert got[5]["type"] == "revisit" and got[5]["refers_to"] == "urn:page:2" and got[5]["payload_digest"] == W.digest(bodies[2])
    for x in got:
        one = zlib.decompressobj(31).decompress(data[x["offset"] :])
        assert one.startswith(b"WARC/1.1") and x["id"].encode() in one


def test_revisits_are_held_to_their_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "other")], "page_id long, url string, html string")
    rows = W.with_revisits(pages)
    assert W.wrong_revisits(W.read_archives(W.write_archives(rows, str(tmp_path / "a")))).count() == 0
    from pyspark.sql import functions as F

    bad = rows.withColumn("refers_to", F.when(F.col("refers_to").isNotNull(), "urn:page:3"))
    assert [r["record_id"] for r in W.wrong_revisits(W.read_archives(W.write_archives(bad, str(tmp_path / "b")))).collect()] == ["urn:page:1"]


def test_damage_is_seen():
    good = page(1, b"hello world")
    plain = zlib.decompress(good, 31)
    again = lambda x: zlib.compress(x, wbits=31)
    bad = [good[:-9], good[:30], b"nonsense" * 4, again(plain.replace(b"hello", b"jello")), again(plain.replace(b"Content-Length: 9", b"Content-Length: 8", 1)), again(plain + b"x"), again(plain[:-6]), again(b"no headers")]
    for x in bad:
        with pytest.raises(W.WarcError):
            list(W.read_records(io.BytesIO(x)))


def test_pages_through_archives(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "same"), (2, "b", "same"), (3, None, None), (4, "d", ""), (5, "e", "é" * 1000), (5, "e", "é" * 1000), (None, "f", "same"), (6, "g", "x" * 200000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n int, sha string")
    out = W.read_archives(W.write_archives(W.with_revisits(pages), str(tmp_path / "w"), archive_bytes=500))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out.collect())
    d = lambda t: W.digest((t or "").encode())
    u = "urn:page:"
    assert got == sorted([(u + "1", "revisit", u + "2", 4, d("same")), (u + "2", "response", None, 4, d("same")), (u + "null", "revisit", u + "2", 4, d("same")), (u + "3", "revisit", u + "4", 0, d("")), (u + "4", "response", None, 0, d("")), (u + "5", "response", None, 2000, d("é" * 1000)), (u + "5", "response", None, 2000, d("é" * 1000)), (u + "6", "response", None, 200000, d("x" * 200000))], key=lambda x: (x[0], x[1], x[2] or "", x[3], x[4]))
    assert W.read_archives(W.write_archives(W.with_revisits(pages.limit(0)), str(tmp_path / "e"))).count() == 0


# BPE


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    with open(B.tokenizer_path(), encoding="utf-8") as f:
        return B.load("test", f.read()), Tokenizer.from_file(B.tokenizer_path())


def check_bpe(both, text):
    mine, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text).tolist()
    assert got == want
    assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_on_odd_texts(both):
    rng = random.Random(1)
    for t in ODD:
        check_bpe(both, t or "")
    for _ in range(300):
        check_bpe(both, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F600, 0x1F640), 32, 10, 9])) for _ in range(rng.randint(0, 80))))


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_bpe_property(both, text):
    check_bpe(both, text)


def test_bpe_remembers_in_generations(both, monkeypatch):
    monkeypatch.setattr(B, "WORDS", 5)
    rng = random.Random(2)
    for _ in range(50):
        check_bpe(both, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(20)))


def test_bpe_query_on_documents(spark, both):
    out = {r["doc_id"]: r for r in B.op5_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for i, t in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        r = out[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert B.bpe_roundtrip(docs(spark, [])).count() == 0
    assert [tuple(r) for r in B.encoded(docs(spark, [(None, None)])).select("doc_id", "n_tokens").collect()] == [(None, 0)]


# token counts


def test_token_sums_match_brute_force(spark, both):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(0, 60)) for i in range(80)] + [(80, None), (80, None), (81, "a b c " * 6000)]
    lengths = [len(both[0].encode(t or "")) for _, t in rows]
    sums = C.limits(C.histogram(C.token_lengths(docs(spark, rows).drop("n_tokens")))).cache()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert (r["docs_within"], r["tokens_within"], r["docs_cut"], r["truncated_tokens"]) == (sum(x <= limit for x in lengths), sum(x for x in lengths if x <= limit), sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    assert [r["n_tokens"] for r in sums.orderBy("n_tokens").collect()] == sorted(set(lengths))
    for limit in (0, 1, 17, 5000, 10**6):
        assert C.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert C.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert C.limits(C.histogram(C.token_lengths(docs(spark, []).drop("n_tokens")))).count() == 0


def test_token_query_on_documents(spark, both):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    lengths = sorted(len(both[1].encode(t or "", add_special_tokens=False).ids) for t in texts)
    want = {x: (lengths.count(x), sum(y <= x for y in lengths), sum(y for y in lengths if y <= x), sum(y > x for y in lengths), sum(min(x, y) for y in lengths), sum(y <= x for y in lengths) / len(lengths)) for x in set(lengths)}
    assert {r[0]: tuple(r)[1:] for r in C.op7_token_counts(spark, "/root/testdata/sf0.001").collect()} == want
    some = spark.createDataFrame([(3,), (None,), (3,), (1 << 30,)], "n_tokens long")
    assert sorted(map(tuple, C.histogram(some).collect())) == [(3, 2), (1 << 30, 1)]


# SimHash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    rng = random.Random(6)
    for t in [*ODD, *(" ".join(rng.choice(["A", "b", "Ç", "zz"]) for _ in range(rng.randint(1, 40))) for _ in range(100)), "a\x1cb\x85c d"]:
        assert H.simhash((t or "").encode()) == brute_print(t), t


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts = base + [b[:-1] + "q" for b in base[:60]] + base[:20] + ["", None, "  ", ODD[5], ODD[6]]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components(prints)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, i), i)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.near_duplicates(docs(spark, rows)).collect()}
    assert out == {i: (f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, groups, strict=True)}
    kept = H.near_deduplicated(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs(spark, []).columns
    assert H.near_duplicates(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in H.near_duplicates(docs(spark, [(None, "a"), (None, "a"), (None, "b c d e")])).collect()] == [None] * 3


def test_links_in_dense_and_sharded_prints(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for s in seeds for _ in range(12)}
    points = np.array(sorted(points), np.uint64)
    groups = brute_components([int(x) for x in points])
    for parts in (1, 12):
        nodes = H.plan(points, parts)
        assert (len(nodes) > 3) == (parts > 1)
        edges = [(int(x), int(y)) for _, home, visit in H.route(nodes, points, 2) for x, y in zip(*H.linked(home, visit, 2), strict=True)]
        assert all((x ^ y).bit_count() <= 2 for x, y in edges)
        place, parent = {int(p): i for i, p in enumerate(points)}, list(range(len(points)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in edges:
            parent[find(place[x])] = find(place[y])
        mine = [find(i) for i in range(len(points))]
        assert len(set(zip(mine, groups, strict=True))) == len(set(groups)) == len(set(mine))


def test_shards_are_parted_again(spark, monkeypatch):
    rng = np.random.default_rng(10)
    seeds = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = sorted({int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for s in seeds for _ in range(5)})
    monkeypatch.setattr(H, "SHARD", 400)
    monkeypatch.setattr(H, "CROWD", 500)
    prints = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    sharded = H._sharded(prints, len(points), 2)
    assert sharded.filter("home").count() == len(points) and sharded.select("shard").distinct().count() > 4
    groups = brute_components(points)
    found = dict(map(tuple, components(H.hamming_links(prints, len(points))).collect()))
    mine = [found.get(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(points)]
    assert len(set(zip(mine, groups, strict=True))) == len(set(groups)) == len(set(mine))


def test_few_copies_for_a_million_prints():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 1 << 63, 1_000_000, dtype=np.uint64))
    nodes = H.plan(points[rng.permutation(len(points))[: H.SAMPLE]], -(-len(points) // H.SHARD))
    sizes = [len(home) + len(visit) for _, home, visit in H.route(nodes, points, H.RADIUS)]
    assert sum(sizes) < 4 * len(points) and max(sizes) < H.CROWD


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(300, 301), (301, 300), (5, 5)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(7, 60), 7), 300: 300, 301: 300}


# exact dedup


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "A"), (6, "x" * 50000), (7, "x" * 50000), (7, "x" * 50000), (None, "only"), (None, "only"), (8, "é"), (9, "é")]
    out = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_dedup(docs(spark, rows)).collect()), key=str)
    best, size = {}, {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
        size[t or ""] = size.get(t or "", 0) + 1
    keep = {t: None if i < 0 else i for t, i in best.items()}
    assert out == sorted(((str(i), keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    kept = E.deduplicated(docs(spark, rows))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted({(str(keep[t or ""]), t or "") for _, t in rows})
    assert E.exact_dedup(docs(spark, [])).count() == 0 and E.deduplicated(docs(spark, [])).count() == 0


def test_counts_beyond_32_bits():
    one = E.CountingQuotientFilter.of(0, 0, np.array([5, 9], np.uint64), np.array([1 << 31, 1], np.int64))
    two = E.CountingQuotientFilter.of(0, 0, np.array([7, 5], np.uint64), np.array([1 << 40, 1 << 31], np.int64))
    keys, counts = E.CountingQuotientFilter.merged([E.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in (one, two, one)]).items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {5: 3 << 31, 7: 1 << 40, 9: 2}


@settings(max_examples=60, deadline=None)
@given(parts=st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=5), bits=st.integers(0, 5))
def test_filters_merge_without_loss(parts, bits):
    spread = lambda v: (v * 0x9E3779B97F4A7C15) % 2**64
    for block in range(1 << bits):
        filters = []
        for p in parts:
            mine = np.array([x for x in map(spread, p) if x >> (64 - bits) == block or not bits], np.uint64)
            filters.append(E.CountingQuotientFilter.from_bytes(E.CountingQuotientFilter.of(block, bits, mine).to_bytes()))
        keys, counts = E.CountingQuotientFilter.merged(filters).items()
        every = [x for p in parts for x in map(spread, p) if x >> (64 - bits) == block or not bits]
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: every.count(k) for k in set(every)}


# language


def test_language_of_held_out_documents(spark):
    from pyspark.sql import functions as F

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = L.op2_language(spark, SF).join(truth, "doc_id").cache()
    assert out.count() == truth.count()
    held = out.filter("held_out")
    assert held.count() == sum(zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in truth.select("doc_id").collect())
    assert held.filter("lang_pred = lang").count() >= 0.98 * held.count()
    assert out.filter("rejected").count() <= 0.005 * out.count()
    assert out.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_language_edges(spark):
    model = L.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "漢字漢字漢字"), (5, "The and of the thing"), (None, "der die das und"), (7, "la " * 50000), (5, "The and of the thing")]
    out = L.identify(docs(spark, rows).withColumnRenamed("n_tokens", "score"), model).collect()
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["rejected"]) for r in out)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and all(g[2] for g in got if g[0] in (1, 2, 3, 4))
    assert {g[1] for g in got if g[0] == 5} == {"en"} and not any(g[2] for g in got if g[0] in (0, 5))
    assert out[0]["keep_id"] == "k"
    nothing = L.fit(docs(spark, []).select("doc_id", "text", "lang"))
    assert [(r["lang_pred"], r["score"]) for r in L.identify(docs(spark, [(1, "abc")]), nothing).collect()] == [("und", 0.0)]


# toxicity


def test_toxicity_of_held_out_labels(spark):
    table = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels, documents = table("labels"), table("documents").join(table("labels").select("doc_id"), "doc_id", "left_semi")
    chain = T.fit(documents, labels.filter("doc_id % 2 = 0"))
    out = T.classify(documents, chain).withColumnRenamed("toxic", "said").join(labels, "doc_id").filter("doc_id % 2 = 1").toPandas()
    assert (out.said == (out.toxic == 1)).mean() > 0.96
    assert out[out.said].toxic.mean() > 0.9 and out[out.toxic == 1].said.mean() > 0.75
    assert ((out.p_low_quality >= 0.5) == (out.quality == 0)).mean() > 0.95


def test_chain_feeds_out_of_fold_predictions():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = np.stack([x[:, 0] > 0, x[:, 0] + 0.1 * rng.normal(size=300) > 0], 1).astype(float)
    chain = T.Chain([], ["a", "b"]).fit(x, y, np.arange(300) % 3)
    assert len(chain.models[0]) == 5 and len(chain.models[1]) == 6
    assert ((T._chance(x, chain.models[0]) > 0.5) == y[:, 0]).mean() > 0.95


def test_toxicity_edges(spark):
    d = docs(spark, [(1, None), (2, "fine words here"), (None, "x" * 40000), (2, "fine words here")])
    empty = T.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["toxic"] for r in T.classify(d, empty).collect()] == [False] * 4
    some = T.fit(d, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert T.classify(d, some).count() == 4 and T.classify(docs(spark, []), some).count() == 0


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(map(tuple, source.select("doc_id", "text").collect()))
    items = list(map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    from tests.llm.test_native import brute_items

    last, rows = source, set(texts)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, last, SF)
        assert out.columns == source.columns and out.dtypes == source.dtypes
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= rows
        if name == "language":
            assert len(ids) >= 0.995 * len(rows)
        elif name == "exact_dedup":
            assert set(ids) == {max(i for i in rows if texts[i] == t) for t in {texts[i] for i in rows}}
        elif name == "near_dedup":
            assert set(ids) == {i for i, _ in brute_survivors([(i, texts[i] or "") for i in sorted(rows)])}
        else:
            assert rows - set(ids) == set(brute_items([(i, texts[i]) for i in rows], items))
        from schemaloom.llm._common import written

        last, rows = written(out, "test"), set(ids)
    out = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == rows and os.path.exists(B.tokenizer_path())


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as P

    text = "The and of the thing in the house was not for them, and that is all there is to say of it today"
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, text + " again"), (None, "der die das und ist nicht ein haus"), (-1, "der die das und ist nicht ein haus"), (5, "123 456"), (6, "prefix words here " + ITEM), (7, "la casa de los " * 20000), (None, "solo aqui en la casa de los libros"), (None, "solo aqui en la casa de los libros")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sha string, fp long, keep_id int, n int"
    source = spark.createDataFrame([(i, t, "en" if t and t[0] in "Tp" else "de" if t and t[0] == "d" else None if t is None else "es", None, None, "s", 1, 2, 3) for i, t in rows], schema)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == source.columns
        left.append(sorted((str(r.doc_id), (r.text or "")[:8]) for r in docs_.collect()))
    assert left[0] == sorted((str(i), (t or "")[:8]) for i, t in rows if i not in (1, 2, 5))
    assert left[1] == sorted({(str(i), (t or "")[:8]) for i, t in rows if i not in (1, 2, 5) and not (i is None and t[0] == "d")})
    assert ("6", "prefix w") not in left[3] and len(left[3]) == len(left[2]) - 1
    assert P.run(spark, str(tmp_path)).count() == len(left[3])
    empty = tmp_path / "empty"
    source.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert P.run(spark, str(empty)).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_contract_queries_against_sql(spark):
    from schemaloom.llm import registered
    from tests.helpers import same

    queries, oracle = registered()
    assert {n.split("_")[0] for n in queries} == {f"op{i}" for i in range(1, 11)} and len(queries) == 10
    for name, sql in oracle.items():
        assert same(queries[name](spark, SF), sql, SF), name


# the pipeline's near-duplicate stage


def brute_survivors(rows):
    """Of each group that links of five-word Jaccard 0.8 hold together, the row with the least id, null last, then the least digest."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= (len(sets[i]) + len(sets[j]) - both) * 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return [min((i is None, i or 0, hashlib.sha256(t.encode()).hexdigest(), (i, t)) for (i, t), x in zip(rows, group, strict=True) if x == g)[3] for g in set(group)]


def test_stage_drops_what_five_word_jaccard_joins(spark, monkeypatch):
    import corpus_pipeline as P

    rng = random.Random(11)
    rows, at = [], 1
    for length in (8, 9, 12, 20, 40, 80, 200, 900):
        for _ in range(12):
            base = [f"w{rng.randrange(5000)}" for _ in range(length)]
            for edits in (0, 1, 1, 2, max(1, length // 50), max(1, length // 40), max(1, length // 25)):
                words = base.copy()
                for _ in range(edits):
                    words[rng.choice((0, length - 1, rng.randrange(length)))] = f"x{rng.randrange(5000)}"
                rows.append((at, " ".join(words)))
                at += 1
    rows += [(None, rows[0][1] + " "), (None, "null ids only are a group here too"), (None, "null ids only are a group here  too"), (at, "a b"), (at + 1, "A  b"), (at + 2, "c d")]
    want = {t for _, t in brute_survivors(rows)}
    kept = P.near_stage(spark, docs(spark, rows), SF).collect()
    assert len(kept) == len(want) < len(rows) and {r["text"] for r in kept} == want
    assert P.near_stage(spark, docs(spark, []), SF).count() == 0
    monkeypatch.setattr(N, "LEAF", 4)  # most groups are large now
    kept = P.near_stage(spark, docs(spark, rows), SF).collect()
    assert len(kept) == len(want) and {r["text"] for r in kept} == want


def test_language_rejects_gibberish_and_untaught_languages(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.fit_on(source)
    rng = random.Random(12)
    strange = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(k)) for k in (1, 5, 20, 50, 200, 1000)]
    strange += [
        "La mattina del giorno dopo il vecchio pescatore scese verso il porto con la sua barca e le reti piene di speranza perche il mare era calmo",
        "Wczesnym rankiem stary rybak poszedł do portu ze swoją łodzią i sieciami pełnymi nadziei ponieważ morze było spokojne",
        "Varhain aamulla vanha kalastaja meni satamaan veneensä ja verkkojensa kanssa koska meri oli tyyni ja tuuli puhalsi hiljaa",
        "Рано утром старый рыбак пошел в порт со своей лодкой и сетями потому что море было спокойно", "Νωρίς το πρωί ο γέρος ψαράς πήγε στο λιμάνι με τη βάρκα του",
    ]
    assert model.predict(strange)[2].tolist() == [True] * len(strange)
    assert model.predict(["The and of the thing", "der die das und"])[2].tolist() == [False] * 2
    short = [" ".join(r[0].split()[:10]) for r in source.filter(L.held_out()).select("text").collect() if r[0]]
    assert model.predict(short)[2].mean() < 0.03


def test_language_bounds_follow_the_length():
    rng = np.random.default_rng(13)
    grams = np.repeat([50, 300, 1000, 5000], 1000)
    cosines = (np.repeat([0.3, 0.5, 0.7, 0.9], 1000) + rng.uniform(0, 0.05, 4000)).astype(np.float32)
    cosines[[0, 1000, 2000, 3000]] = 0.01  # one outlier in each band
    few = (np.full(5, 0.2, np.float32), np.full(5, 5000))
    got = L.bounds([cosines, few[0]], [grams, few[1]])
    assert np.allclose(got[0], [0.3 * (128 / 50) ** 0.5, 0.5, 0.7, 0.9], atol=0.01) and np.allclose(got[1, :3], got[0, :3]) and got[1, 3] < 0.9
    assert L.bounds([], []).shape == (0, 4)


# columns and ids of any name and type

NAMES = ("_id", "_sha", "_hot", "_salt", "_got", "_h", "_k", "key", "sha", "parts", "part", "weight", "row", "n", "fp", "uid", "comp", "a.b", "lang_pred", "score")


@pytest.mark.parametrize(("limit", "id_type"), [(200_000, "long"), (0, "string")])
def test_stages_keep_columns_of_any_name(spark, monkeypatch, limit, id_type):
    from schemaloom.llm import _common as common
    from schemaloom.llm import decontaminate as D

    monkeypatch.setattr(common, "small", lambda df, rows=0, real=common.small: real(df, limit))
    kind = "long" if id_type == "long" else "string"
    ident = (lambda i: i) if id_type == "long" else (lambda i: None if i is None else f"m{i}")
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(ident(i), t, "en") for i, t in [(1, words), (2, words), (2, words), (3, words + " more"), (4, "one other text that is alone here"), (None, "x y"), (5, "holds " + ITEM), (6, None), (7, "")]]
    schema = f"doc_id {kind}, text string, lang string, " + ", ".join(f"`{c}` string" for c in NAMES)
    source = spark.createDataFrame([(*r, *(f"{c}-{i}" for c in NAMES)) for i, r in enumerate(rows)], schema)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    every = set(map(tuple, source.collect()))
    for stage, left in ((E.deduplicated, 6), (N.without_near_copies, 5), (H.near_deduplicated, None), (lambda d: D.decontaminated(d, bench), 8), (L.with_known_language, None)):
        out = stage(source)
        assert out.columns == source.columns and out.dtypes == source.dtypes
        got = list(map(tuple, out.collect()))
        assert set(got) <= every and (left is None or len(got) == left), (stage, len(got), left)
    assert sorted(r["doc_id"] or "" for r in H.near_duplicates(source).collect() if id_type == "string") == (sorted(r[0] or "" for r in rows) if id_type == "string" else [])
