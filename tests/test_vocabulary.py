"""The vocabulary's rules on random small vocabularies against a walk through the rules, row by row."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from schemaloom.functions.names import distinct_ignoring_case
from schemaloom.operators import vocabulary as voc
from schemaloom.operators.model import of_rows
from schemaloom.plans.vocabularies import ENTITIES, MAPPINGS, TERMS, Vocabulary, build_vocabulary

NAMES = ["Number", "number", "Loan Date", "loan date", "Shelf", "Book Copy Code", "Code", "code", "Reader", "Town", "loan_no"]
SOURCES = ["Loan.number", "Loan.loan_date", "Book Copy.code", "Book Copy.copy_code", "Reader.town", "Gone.number", "reader.Town", "Book Copy.book_copy_id"]


def key(x):
    return re.sub("[^a-z0-9]", "", x.lower())


def full_key(x):
    a, dot, b = x.partition(".")
    return key(a) + "." + key(b) if dot else key(a)


def firsts(values, by=str.lower):
    seen = {}
    for v in values:
        seen.setdefault(by(v), v)
    return list(seen.values())


def some_terms(rng, n):
    names = firsts(rng.sample(NAMES, n))
    return [(x, rng.choice([None, "", "short", "a longer one", "another 1234"]), rng.sample(NAMES, rng.randint(0, 3)), rng.sample(SOURCES, rng.randint(0, 3)), i) for i, x in enumerate(names)]


def shown(df):
    return [(r["name"], r["description"], list(r["synonyms"]), list(r["sources"])) for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_merging(spark, seed):
    rng = random.Random(seed)
    old, new = some_terms(rng, 5), some_terms(rng, 6)
    held = {t[0].lower(): [t[0], t[1], list(t[2]), list(t[3])] for t in old}
    joins = {}
    for name, _, synonyms, _, _ in old:
        joins |= {s.lower(): name.lower() for s in synonyms} | {name.lower(): name.lower()}
    for name, text, synonyms, sources, _ in new:
        home = joins.get(name.lower())
        if home is None:
            held[name.lower()] = [name, text, list(synonyms), list(sources)]
            continue
        t = held[home]
        t[2] += [name, *synonyms]
        if len(text or "") > len(t[1] or ""):
            t[1] = text
        t[3] = list(sources)
    want = [(n, d, [s for s in firsts(y) if s.lower() != n.lower()], x) for n, d, y, x in held.values()]
    assert shown(voc.merge_terms(spark.createDataFrame(old, TERMS), spark.createDataFrame(new, TERMS))) == want


@pytest.mark.parametrize("seed", range(4))
def test_alignment_and_ownership(spark, seed):
    rng = random.Random(seed)
    terms = some_terms(rng, 5)
    mappings = [(rng.choice(SOURCES), rng.choice(NAMES), 0.5, "", i) for i in range(8)]
    held = {t[0].lower(): [t[0], t[1], list(t[2]), list(t[3])] for t in terms}
    synonym = {s.lower(): t[0].lower() for t in terms for s in t[2]}
    named = []
    for attribute, canonical, *_ in mappings:
        low = canonical.lower()
        low = low if low in held or low not in synonym else synonym[low]
        t = held.setdefault(low, [canonical, None, [], []])
        if attribute not in t[3]:
            t[3].append(attribute)
        named.append((attribute, t[0]))
    want = [(n, d, [s for s in firsts(y) if s.lower() != n.lower()], list(dict.fromkeys(x))) for n, d, y, x in held.values()]
    out, moved = voc.aligned(spark.createDataFrame(terms, TERMS), spark.createDataFrame(mappings, MAPPINGS))
    assert shown(out) == want
    assert [(r["attribute"], r["canonical"]) for r in moved.orderBy("seq").collect()] == named
    owner, last = {}, {}
    for attribute, canonical in named:
        owner[full_key(attribute)], last[full_key(attribute)] = canonical.lower(), attribute
    owned = []
    for n, d, y, x in want:
        mine = [s for s in x if owner.get(full_key(s), n.lower()) == n.lower()] + [last[k] for k in owner if owner[k] == n.lower()]
        owned.append((n, d, y, firsts(mine, full_key)))
    assert shown(voc.owned_sources(out, moved)) == owned


def test_long_lists_of_sources(spark):
    n = 20_000
    sources = [f"Shelf{i % 7}.row_{i // 2}" if i % 2 else f"SHELF{(i + 1) % 7}.Row {i // 2}" for i in range(n)] + ["", None]
    terms = spark.createDataFrame([("Row", None, [], sources, 0)], TERMS)
    mappings = spark.createDataFrame([(f"Shelf{i % 7}.row_{i // 2}", "row", 0.5, "", i) for i in range(1, n, 2)], MAPPINGS)
    begun = time.time()
    got = voc.owned_sources(terms, mappings).first()["sources"]
    assert got == firsts(sources[:n], full_key)
    listed = spark.createDataFrame([(["b", "A", None, "B", "a", "c"],), ([],), (None,)], "x array<string>").select(distinct_ignoring_case(F.col("x")).alias("x"))
    assert [r["x"] for r in listed.collect()] == [["b", "A", "c"], [], None]
    assert time.time() - begun < 60  # not the square of the list's length


def test_abstract_terms_join(spark):
    terms = [("Book Copy Code", "one", ["copy code"], ["Book Copy.code"], 0), ("Code", "a longer one", ["sign"], [], 1), ("Loan Date", "", [], ["Loan.loan_date"], 2), ("shelf_no", None, [], [], 3)]
    mappings = [("Book Copy.code", "book copy code", 0.5, "", 0), ("Shelf.shelf_no", "Shelf_No", 0.5, "", 1), ("Loan.loan_date", "Loan Date", 0.5, "", 2)]
    out, moved = voc.abstract_terms(spark.createDataFrame(terms, TERMS), spark.createDataFrame(mappings, MAPPINGS))
    assert shown(out) == [("Code", "a longer one", ["copy code", "Book Copy Code", "sign"], ["Book Copy.code"]), ("Loan Date", "", [], ["Loan.loan_date"]), ("Shelf No", None, ["shelf_no"], [])]
    assert [r["canonical"] for r in moved.orderBy("seq").collect()] == ["Code", "Shelf No", "Loan Date"]


def test_coverage_counts_earlier_decisions(spark):
    attrs = of_rows(spark, {"entities": [{"name": "Shelf", "attributes": [{"name": "rowNumber"}]}, {"name": "Hall", "attributes": [{"name": "row_number"}, {"name": "row_numbers"}, {"name": "book_hall_floor"}]}, {"name": "Book Hall", "attributes": [{"name": "book_hall_floor"}, {"name": "sign"}]}]}).attributes
    terms = spark.createDataFrame([("Mark", None, ["Sign"], [], 0)], TERMS)
    got = [(r["attribute"], r["canonical"], r["confidence"]) for r in voc.covered(spark.createDataFrame([], MAPPINGS), attrs, terms).orderBy("epos", "apos").collect()]
    assert got == [("Shelf.rowNumber", "Row Number", 0.55), ("Hall.row_number", "Row Number", 0.75), ("Hall.row_numbers", "Row Number", 0.7), ("Hall.book_hall_floor", "Book Hall Floor", 0.55), ("Book Hall.book_hall_floor", "Book Hall Floor", 0.75), ("Book Hall.sign", "Mark", 0.68)]


def test_run_with_proposal_and_existing(spark):
    erd = of_rows(spark, {"entities": [{"name": "Reader", "primary_key": ["card"], "attributes": [{"name": "card", "is_primary_key": True}, {"name": "town"}]}, {"name": "Loan", "attributes": [{"name": "card", "references": "Reader.card"}, {"name": "due_date"}]}]})
    existing = Vocabulary(spark.createDataFrame([("Place", "where", ["Town"], ["Old.town"], 0), ("Colour", None, [], [], 1)], TERMS), spark.createDataFrame([("Reader.town", "Place", 0.6, "seen", 0), ("Old.town", "Place", 0.9, "", 1)], MAPPINGS), spark.createDataFrame([("Reader", "Library Reader", 0.9, "", 0)], ENTITIES))
    proposal = Vocabulary(spark.createDataFrame([("town", "where one lives", [], ["People.town"], 0), ("Due", None, [], ["Loan.due_date"], 1)], TERMS), spark.createDataFrame([("People.town", "town", 0.5, "", 0), ("Loan.due_date", "Due", 0.8, "", 1), ("Shop.x", "X", 0.9, "", 2)], MAPPINGS), spark.createDataFrame([("Loan", "Lending", 0.7, "", 0)], ENTITIES))
    out = build_vocabulary(erd, "proposal", proposal, existing)
    assert {(r["attribute"], r["canonical"], r["confidence"]) for r in out.mappings.collect()} == {("Reader.town", "Place", 0.6), ("Loan.due_date", "Due", 0.8), ("Reader.card", "Identifier", 0.55), ("Loan.card", "Identifier", 0.75)}
    assert {(r["name"], tuple(r["synonyms"]), tuple(r["sources"]), tuple(r["roles"])) for r in out.terms.collect()} == {("Place", ("Town",), ("Reader.town",), ("descriptive_quality",)), ("Due", (), ("Loan.due_date",), ("temporal_quality",)), ("Identifier", ("Card",), ("Reader.card", "Loan.card"), ("foreign_identifier", "identifier"))}
    assert {r["name"] for r in out.archived.collect()} == {"Colour", "Card"}
    assert {(r["source_entity"], r["canonical"]) for r in out.entities.collect()} == {("Reader", "Library Reader"), ("Loan", "Lending")}
    with pytest.raises(ValueError):
        build_vocabulary(erd, "proposal")
    rules = build_vocabulary(erd, "rule_based")
    assert {r["attribute"] for r in rules.mappings.collect()} == {"Reader.card", "Reader.town", "Loan.card", "Loan.due_date"}


def walked_cover(mappings, attributes, terms):
    """The rules of ``covered`` gone through one attribute after another, from the facts of each."""
    from schemaloom.functions.names import bare_key, qualified_key, term, tokens

    shown = F.concat_ws(".", "entity", "attr")
    title = voc.once(tokens("attr"), lambda w: F.when(F.size(w) == 0, F.col("attr")).otherwise(term(w)))
    short = voc.once(title, lambda t: F.coalesce(F.nullif(voc.abstract_name(t, F.array("attribute")), F.lit("")), t))
    known = {r[0] for r in mappings.select(qualified_key("attribute")).collect()}
    rows = attributes.select("*", shown.alias("attribute")).select("attribute", qualified_key("attribute").alias("key"), bare_key("attr").alias("part"), short.alias("short"), bare_key(short).alias("short_key"), bare_key(title).alias("title_key")).orderBy("epos", "apos").collect()
    voted = {r["part"]: r["name"] for r in voc.votes(mappings, terms).collect()}
    named, synonyms = {}, {}
    bare = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
    for t in terms.orderBy("pos").collect():
        named.setdefault(bare(t.name), t.name)
        for s in t.synonyms:
            synonyms.setdefault(bare(s), t.name)
    named.pop("", None), synonyms.pop("", None)
    out = []
    for r in [r for r in rows if r["key"] not in known]:
        how, name = ("votes", voted[r["part"]]) if r["part"] in voted else ("new", r["short"])
        if how == "new":
            hits = [(kind, index[k]) for k in (r["short_key"], r["title_key"]) for kind, index in (("name", named), ("synonym", synonyms)) if k in index]
            if hits:
                how, name = hits[0]
            else:
                named[r["short_key"]] = name
        if r["part"]:
            voted.setdefault(r["part"], name)
        out.append((r["attribute"], name, how))
    return out


@pytest.mark.parametrize("seed", [1])
def test_coverage_in_rounds_is_the_walk(spark, seed):
    rng = random.Random(seed)
    entities = ["Loan Desk Clerk", "loanDesk", "Desk", "Clerk Loan Desk"]
    words = ["loan", "desk", "clerk", "name", "code", "Note", "id"]
    attrs, seen = [], set()
    for i in range(120):
        e, a = rng.randrange(4), rng.choice((" ", "_", "")).join(rng.choices(words, k=rng.choice((1, 2, 3, 3, 4)))) if rng.random() < 0.95 else rng.choice(("-", "—"))
        if (e, a) not in seen:
            seen.add((e, a))
            attrs.append((entities[e], a, e, i))
    attributes = spark.createDataFrame(attrs, "entity string, attr string, epos int, apos int")
    mappings = spark.createDataFrame([(f"{e}.{a}", "Approved Name", 0.9, "", i) for i, (e, a, _, _) in enumerate(attrs[:6])], "attribute string, canonical string, confidence double, rationale string, seq int")
    terms = spark.createDataFrame([("Note", None, ["desk note", "Loan Name"], ["Desk.code"], 0), ("Name Code", None, ["note"], [], 1), ("Clerk Id", None, ["loan name", ""], [], 2)], "name string, description string, synonyms array<string>, sources array<string>, pos int")
    got = [(r.attribute, r.canonical, r.source) for r in voc.covered(mappings, attributes, terms).orderBy("epos", "apos").collect()]
    want = walked_cover(mappings, attributes, terms)
    assert got == want and {h for _, _, h in want} >= {"votes", "name", "new"}


def test_columns_of_any_name_are_kept(spark):
    terms = spark.createDataFrame([("Loan Date", ["Loan.date", "Gone.x"], "k", "l", "u", 1), ("Old", [], "k2", "l2", "u2", 2)], "name string, sources array<string>, key string, kept string, used string, `a.b` int")
    maps = spark.createDataFrame([("loan.Date", "Loan Date", 0, "k", "s", "l")], "attribute string, canonical string, seq int, key string, shown string, last string")
    attrs = spark.createDataFrame([("Loan", "date")], "entity string, attr string")
    kept, gone = voc.archive(terms, maps)
    assert [tuple(r) for r in kept.collect()] == [("Loan Date", ["Loan.date", "Gone.x"], "k", "l", "u", 1)] and [r.name for r in gone.collect()] == ["Old"]
    assert sorted(tuple(r) for r in voc.stale_sources(terms, attrs).collect()) == [("Loan Date", ["Loan.date"], "k", "l", "u", 1), ("Old", [], "k2", "l2", "u2", 2)]
    assert [tuple(r) for r in voc.valid_mappings(maps, attrs).collect()] == [("Loan.date", "Loan Date", 0, "k", "s", "l")]
    assert [(r.seq, r.last) for r in voc.carried_forward(maps, maps).orderBy("seq").collect()] == [(0, "l"), (1, "l")]
    entities = maps.select(F.lit("LOAN").alias("source_entity"), "canonical", "key", "shown")
    assert [tuple(r) for r in voc.valid_entity_mappings(entities, attrs.select("entity")).collect()] == [("Loan", "Loan Date", "k", "s")]
