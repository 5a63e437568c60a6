"""Sharding, secret ledger, decontamination: against plain Python on small fixtures, with nulls, repeats, empties and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest

from schemaloom.llm import decontaminate as D
from schemaloom.llm import secrets as S
from schemaloom.llm._common import attach
from schemaloom.llm.sharding import CommitConflict, ShardStore

DOCS = "doc_id long, text string, n long, blob string, sha string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "b", "s") for i, t in rows], DOCS)


# sharding


def test_shards_hold_every_row_once_and_compact(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), target=6000, least=3)
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(200)] + [(5, None), (5, None), (None, ""), (200, "y" * 20000)]
    for part in range(8):
        store.append(docs(spark, rows[part::8]).repartition(3))
    before = store.manifest().count()
    version = store.compact()
    after = store.manifest()
    assert after.count() < before
    assert version == store.version() and store.manifest(8).count() == before  # old versions stay readable
    got = Counter((r.doc_id, r.text) for r in store.read().select("row.doc_id", "row.text").collect())
    assert got == Counter(rows)
    assert after.agg({"rows": "sum"}).first()[0] == len(rows)
    assert store.compact() == version  # nothing more to do
    for r in after.collect():
        assert r["bytes"] < 6000 * 2 or r["rows"] == 1 or r["level"] == 0


def test_only_one_of_two_writers_commits(spark, tmp_path):
    a, b = (ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    a.append(docs(spark, [(1, "a")]))
    manifest = a.manifest()
    assert b._commit(2, manifest, b.schema()) == 2
    with pytest.raises(CommitConflict):
        a._commit(2, manifest, a.schema())
    assert a.version() == 2
    with pytest.raises(ValueError):
        a.append(docs(spark, [(1, "a")]).drop("n"))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sharding_query_compacts_and_keeps_every_row(spark, sf):
    from schemaloom.llm.sharding import ARRIVALS, op1_sharding

    out = [r.asDict() for r in op1_sharding(spark, f"/root/testdata/sf{sf}").collect()]
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in out) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert max(r["shard_level"] for r in out) >= 1 and {r["version"] for r in out} != {1} and min(r["version"] for r in out) > ARRIVALS
    sizes = Counter(r["shard"] for r in out)
    assert all(sizes[r["shard"]] == r["shard_rows"] and 1 <= r["shard_since"] <= r["version"] for r in out) and len(sizes) > 1


def test_empty_arrivals(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    store.append(docs(spark, []))
    assert store.compact() == 1
    assert store.read().count() == 0


# secrets

FIXED = {
    "assign": (re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute_spans(text):
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(FIXED.items()):
        out += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def secret_texts():
    rng = random.Random(5)
    bits = ["token=", "Secret : ", "api_key='", "APIKEY=", "token", "=", " ", "AKIA", "AKIAAKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "é", "😀", "abcdefgh", "short", "\n", '"', ":", "passwd", "paſſword=abcdefghij", "x" * 9]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return [*made, None, "", "token=token =abcdefgh1", "token=ab secret=abcdefgh", "password=" + "a" * 50000, "f" * 100000 + "g", "token=abcdefgh " * 300]


def test_secrets_match_brute_force(spark, tmp_path):
    texts = secret_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "token=abcdefgh")]
    out = S.secret_scan(docs(spark, rows), S.SecretLedger(spark, str(tmp_path / "ledger"))).collect()
    got = Counter((r["doc_id"], ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secret_spans"])) for r in out)
    assert got == Counter((i, brute_spans(t)) for i, t in rows)
    assert {r["n"] for r in out} == {7} and {r["sha"] for r in out} == {"s"}


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = S.SecretLedger(spark, str(tmp_path / "ledger"))
    ledger.scan(docs(spark, [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "plain")]))
    assert ledger.read().count() == 2 * 3
    ledger.scan(docs(spark, [(4, "plain"), (5, "new one")]))
    assert ledger.read().count() == 3 * 3
    newer = S.SecretLedger(spark, ledger.path, [S.RULES[0], S.RULES[1], S.Rule("hex", r"[0-9a-f]{8,}", version=2)])
    newer.scan(docs(spark, [(1, "token=abcdefgh"), (9, "deadbeef")]))
    assert newer.read().filter("rule = 'hex' and version = 2").count() == 2
    assert newer.read().filter("rule = 'assign'").count() == 4
    assert sorted(s["kind"] for r in newer.findings().collect() for s in r["spans"]) == ["assign", "hex"]


def test_secret_query_scans_arrivals_into_one_ledger(spark, monkeypatch):
    made = []
    real = S.SecretLedger
    monkeypatch.setattr(S, "SecretLedger", lambda *a: made.append(real(*a)) or made[-1])
    assert S.op6_secret_scan(spark, "/root/testdata/sf0.01").count() > 0
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    first = {t or "" for i, t in rows if i % 2 == 0}
    second = {t or "" for i, t in rows if i % 2} - first
    assert second and len(second) < len({t or "" for i, t in rows if i % 2})  # some texts were seen before
    scans = {(r["scan"], r["rule"]): r["pairs"] for r in made[0].scans().collect()}
    assert scans == {(k, rule.kind): len(x) for k, x in ((1, first), (2, second)) for rule in S.RULES}


def test_secrets_of_nothing(spark, tmp_path):
    assert S.secret_scan(docs(spark, []), S.SecretLedger(spark, str(tmp_path / "ledger"))).count() == 0


# decontamination


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def shingles(t):
    w = words(t)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def brute_items(docs_, items):
    out = {}
    for i, t in docs_:
        have = shingles(t)
        hits = sorted(k for k, x in items if shingles(x) and 5 * len(have & shingles(x)) >= 4 * len(shingles(x)))
        if hits:
            out.setdefault(i, []).append(",".join(map(str, hits)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(1, 40))) for i in range(30)] + [(30, None), (31, "..."), (32, "Über, Öl!"), (33, "Über öl")]
    items.append((34, items[20][1].upper()))
    rows = []
    for i in range(120):
        w = text(rng.randint(0, 300)).split()
        if i % 2:
            x = items[rng.randrange(30)][1].split()
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = x
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "über öl"), (7, rows[7][1]), (503, " ".join([text(30000), items[5][1]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.contamination(docs(spark, rows), bench).collect():
        got.setdefault(r["doc_id"], []).append(r["item_ids"])
    assert got == brute_items(rows, items)


def test_a_line_that_all_items_share(spark):
    line = "answer the following question as well as you can please"
    items = [(i, f"{line} " + " ".join(f"i{i}w{k}" for k in range(12))) for i in range(40)]
    rows = [(i, f"{line} something else {i}") for i in range(60)] + [(100 + i, "before " + items[i][1] + " after") for i in range(5)] + [(200, line)]
    bench = spark.createDataFrame([*items, (99, line)], "item_id long, text string")
    got = {r["doc_id"]: [r["item_ids"]] for r in D.contamination(docs(spark, rows), bench).collect()}
    assert got == brute_items(rows, [*items, (99, line)])


def test_nothing_to_decontaminate(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contamination(docs(spark, []), bench).count() == 0
    assert D.contamination(docs(spark, [(1, "a b c d e f")]), bench.limit(0)).count() == 0
    kept = D.decontaminated(docs(spark, [(1, "a b c d e f g"), (1, "other text"), (None, "a b c d e f"), (None, "x")]), bench)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (1, "other text")]
    assert kept.columns == ["doc_id", "text", "n", "blob", "sha"]


# the join that survives hot keys


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("weight", [None, "w"])
def test_attach_beyond_the_broadcast_limit(spark, how, weight):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (3, 1), (4, 2)], "k int, v int")
    right = spark.createDataFrame([(1, "a", 300), (2, "b", 1), (9, "c", 1)], "k int, x string, w long")
    small = right.drop("w") if weight is None else right
    key = lambda df: Counter(tuple(r) for r in df.select(sorted(set(df.columns) - {"w"})).collect())
    assert key(attach(left, small, ["k"], how, weight, limit=0)) == key(left.join(small, ["k"], how))


def test_digest_is_of_the_whole_text(spark, tmp_path):
    out = S.secret_scan(docs(spark, [(1, "é")]), S.SecretLedger(spark, str(tmp_path / "l"))).first()
    assert bytes(out["blob"]) == hashlib.sha256("é".encode()).digest()


# ids


def test_a_null_id_is_not_the_text_null(spark):
    from schemaloom.llm import exact_dedup as E
    from schemaloom.llm.simhash import near_deduplicated

    rows = spark.createDataFrame([(None, "same text"), ("null", "same text"), ("z", "other"), ("", "same text")], "doc_id string, text string")
    got = Counter((r.doc_id, r.text) for r in E.deduplicated(rows).collect())
    assert got == Counter([("null", "same text"), ("z", "other")])
    assert Counter(r.doc_id for r in near_deduplicated(rows).collect()) == Counter(["", "z"])
