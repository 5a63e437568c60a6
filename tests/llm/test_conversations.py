"""Conversation repair: audits against all edit scripts, the whole against a plain walk, with cut conversations, nulls and repeats."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from schemaloom.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?")
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def scripts(codes, inserts=4):
    """(cost, audit) of every edit script with at most so many inserts whose roles are right."""
    n = len(codes)
    for k in range(inserts + 1):
        for places in set(itertools.combinations_with_replacement(range(n + 1), k)):
            for edits in itertools.product("DKR", repeat=n):
                if any(c == "-" and e != "D" or c in "xX" and e == "K" for c, e in zip(codes, edits, strict=True)):
                    continue
                audit, given = "", []
                for i in range(n + 1):
                    audit += "I" * places.count(i)
                    given += ["ua"] * places.count(i)
                    if i < n:
                        audit += edits[i]
                        given += {"D": [], "K": [codes[i].lower()], "R": ["ua"]}[edits[i]]
                cost = sum(COST[e] for e in audit) + sum(3 for c, e in zip(codes, edits, strict=True) if c.isupper() and e != "D")
                if any(GRAMMAR.fullmatch("".join(x)) for x in itertools.product(*given)):
                    yield cost, audit


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_audits_against_all_scripts(n):
    for codes in itertools.product("suaxUAX-", repeat=n):
        assert C._best(C.block("".join(codes))) == min(scripts(codes)), codes


def walked(codes):
    """The same by the cheapest path, for any length."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(codes) and q in C.ACCEPT:
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        other = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", i, other))
        if i < len(codes):
            c, more = codes[i], 3 * codes[i].isupper()
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if c != "-":
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, other))
                if (q, c.lower()) in C.NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, C.NEXT[q, c.lower()]))


def test_blocks_put_together():
    rng = random.Random(3)
    for n in [*range(1, 60), 200, 1000]:
        codes = "".join(rng.choices("suaxUA-", (1, 9, 9, 1, 2, 2, 2), k=n))
        assert C._best(C.summed(codes)) == walked(codes), codes


def plain(rows):
    """conv_id -> result, by the rules, from rows (conv_id, turn, role, text)."""
    ids = {r[0] for r in rows}
    after = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in after.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        codes, seen, n = "", set(), {"b": 0, "d": 0, "t": 0}
        for _, role, text in turns:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not signs else "d" if (role, text) in seen else "t" if signs[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("b", "d") else code.upper() if fault == "t" else code
        cost, audit = walked(codes)
        given = [t for t, _, _ in turns if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        lines = list(C.repaired(audit, 0, iter([(r, t) for _, r, t in turns])))
        assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, n["b"], n["d"], n["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: tuple(r[1:]) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, gone int, conv string, piece int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], schema)


def conversations(rng, n, longest):
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = ("system" if turn == 0 and rng.random() < 0.3 else "user" if turn % 2 == 0 else "assistant") if rng.random() < 0.9 else rng.choice(("tool", "", None, "system"))
            text = rng.choice(("Yes.", "No", "", " \t", None, "What? ", f"Text {turn}!", f"Text {turn}", "日本。", "..."))
            out.append((conv, rng.choice((turn, turn, turn, turn + 2, None)), role, text))
    return out


def test_whole_conversations_against_a_plain_walk(spark):
    rng = random.Random(8)
    rows = conversations(rng, 250, 9)
    rows += [(None, k, "user", "Null.") for k in range(4)] + [(900, None, None, None), (901, None, "user", "a."), (901, None, "assistant", "b.")] + rows[:30] + [(902, 0, "user", "long " * 50000 + ".")]
    rng.shuffle(rows)
    assert found(C.repair(C.damaged(frame(spark, rows).repartition(7)))) == plain(rows)


def test_conversations_that_are_cut_by_ranges(spark):
    rng = random.Random(9)
    rows = conversations(rng, 12, 8) + [(100, k // 2 if k % 7 else None, "user" if k % 2 else "assistant", f"Turn {k % 900}" + ".?x "[k % 4]) for k in range(4000)] + [(101, 5, "user", "same.")] * 50
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(C.repair(C.damaged(frame(spark, rows).repartition(3)))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_text_ids_and_an_empty_table(spark):
    rows = [("a", 1, "user", "Hi."), ("null", 1, "user", "Hi."), (None, 1, "user", "Hi."), ("", 1, "user", "Hi.")]
    assert found(C.repair(C.damaged(frame(spark, rows, SCHEMA.replace("conv_id long", "conv_id string"))))) == plain(rows)
    assert C.repair(C.damaged(frame(spark, []))).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_a_plain_walk(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.op11_conversation_repair(spark, f"/root/testdata/sf{sf}")) == plain(rows)
