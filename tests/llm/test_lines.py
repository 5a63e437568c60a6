"""Line deduplication against a plain walk, with frequent lines, nulls, repeats, empties and clashing columns."""

import random
from collections import Counter, defaultdict

import pytest

from schemaloom.llm import line_dedup as L

UPPER = {ord(c): ord(c) + 32 for c in L.UPPER}


def plain(rows, least=L.LEAST, documents=L.DOCUMENTS):
    """The kept text of each (id, text)."""
    order = lambda i: (i is not None, i)
    holders = defaultdict(set)
    key = lambda line: line.strip(L.BLANKS).translate(UPPER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    gone = {k: max(v, key=order) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.text, r.n_lines_, r.n_dropped, r.kept_text) for r in df.collect())


SCHEMA = "doc_id long, text string, n_lines int, keep string, tk string, h string, `a.b` int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, 7, "k", "t", "h", 1) for i, t in rows], schema)


def test_lines_against_a_plain_walk(spark):
    rng = random.Random(5)
    shared = [f"This Line is shared by many {k}" for k in range(12)] + ["short line", "Schön ist diese Zeile überall, ja", "x" * 5000]
    rows = []
    for i in range(300):
        lines = [rng.choice((" ", "\t\r", "")) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(("", " \x0b")) for x in rng.choices(shared, k=rng.randrange(6))]
        lines += [f"only document {i} has this line {j % 3}" for j in range(rng.randrange(5))]
        rng.shuffle(lines)
        rows.append((rng.choice((i, i, i, None, 7)), "\n".join(lines)))
    rows += [(1000 + i, "A frequent line that very many documents hold\nown") for i in range(400)]
    rows += [(5000, None), (5000, None), (5001, ""), (5002, "\n"), (1399, "A frequent line that very many documents hold\nown"), (None, "a frequent line that very many documents hold")]
    assert found(L.deduplicated_lines(frame(spark, rows).repartition(5))) == plain(rows)
    two = [("b", "one and the same line of some length"), ("ä", "one and the same line of some length"), ("", "one and the same line of some length")]
    assert found(L.deduplicated_lines(frame(spark, two, SCHEMA.replace("doc_id long", "doc_id string")))) == plain(two)


def test_frequent_hashes_are_cut_and_only_once_shuffled(spark):
    rows = [(i, f"The frequent line that all documents hold\nline number {i} of its own, and long") for i in range(600)]
    frequent = L._frequent(L._occurrences(frame(spark, rows), L.LEAST)).collect()
    assert len(frequent) == 1 and frequent[0].slices > 100
    maps = L.keep_bitmaps(frame(spark, rows)).collect()
    assert len(maps) == 599 and all([tuple(x) for x in m.keep] == [(1, 1)] and m.n_lines == 2 and m.copies == 1 for m in maps)


def test_bitmaps_of_a_long_text_and_of_nothing(spark):
    lines = [f"common line of the long text {k}" if k % 2 else f"own line of the long text {k}" for k in range(20000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(x for x in lines if x[0] == "c")), (3, "\n".join(x for x in lines if x[0] == "c"))]
    assert found(L.deduplicated_lines(frame(spark, rows))) == plain(rows)
    assert L.keep_bitmaps(frame(spark, [])).count() == 0 and L.deduplicated_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("documents", [2, 4])
def test_other_limits(spark, documents):
    rows = [(i, "abcdefg\n" * (i % 3) + "hijk") for i in range(7)]
    assert found(L.deduplicated_lines(frame(spark, rows), 5, documents)) == plain(rows, 5, documents)
