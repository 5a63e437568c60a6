"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Costs are found in layers, as in approximate matching with bit vectors: for each cost, from the least on, a bitset for each
turn holds the grammar's states from which the turns that follow can end well at exactly that cost. The first layer that
holds the start gives the cost; going forward through the bitsets and taking the least letter that stays inside gives the
ASCII-least of the cheapest audits. Layers are made for blocks of at most BLOCK turns, for all states at either end; what
blocks found is put together two by two, so the work grows with a conversation's length and not with its square.

Turns are dealt out by ranges of conversation and turn and sorted, so a conversation stands together in one range, or in
several that follow each other if it is large. A task repairs those that it has whole, one at a time. The first and last of
each range may go on elsewhere: their rows are written out, blocks are made for each piece, pieces are put together by
conversation, and their texts are hashed as a stream in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm._common import attach, id_text, slices, table, written

#: Costs of edits, and what a truncated turn that stays costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a block.
BLOCK = 16
#: White space, the ends of a sentence, roles by initial.
BLANKS, ENDS = " \t\n\x0b\f\r", (".", "!", "?")
ROLES = {"u": "user", "a": "assistant"}
#: The grammar's states: 0 nothing yet, 1 after s, 2 after u, 3 after a. Those that may end, and the state after an initial.
STATES, ACCEPT = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Code points of a text that take part in the dealing out of turns; the order of equal turns goes on with the whole text.
PREFIX = 32

Table = dict[tuple[int, int], tuple[int, str]]


_moves = {x: [(q, r) for (q, y), r in NEXT.items() if y == x] for x in "sua"}


def _before(initial: str, bits: int) -> int:
    """The states from which an initial leads into ``bits``; four bits for each end, side by side."""
    out = 0
    for q, r in _moves[initial]:
        out |= (bits >> r & 0x1111) << q
    return out


def _turned(bits: int) -> int:
    """The states from which a turn of user or assistant, whichever may stand there, leads into ``bits``."""
    return _before("u", bits) | _before("a", bits)


@lru_cache(1 << 13)
def block(codes: str) -> Table:
    """(start, end): (cost, audit) for a block of turns, each ``s``, ``u``, ``a`` or ``x`` (another role), a capital if it is truncated, or ``-`` if it must go."""
    n, least = len(codes), DELETE * len(codes) + 2 * INSERT  # no reachable end costs more
    layers: list[list[int]] = []
    found: Table = {}
    for cost in range(least + 1):
        layer = [0] * (n + 1)
        at = lambda less, i: layers[cost - less][i] if cost >= less else 0
        layer[n] = _turned(at(INSERT, n)) | (0x8421 if cost == 0 else 0)
        for i in range(n - 1, -1, -1):
            bits = _turned(at(INSERT, i)) | at(DELETE, i + 1)
            if (c := codes[i]) != "-":
                extra = TRUNCATED if c.isupper() else 0
                bits |= _turned(at(REROLE + extra, i + 1))
                if (k := c.lower()) != "x":
                    bits |= _before(k, at(extra, i + 1) if extra else layer[i + 1])
            layer[i] = bits
        layers.append(layer)
        for end in range(STATES):
            for start in range(STATES):
                if (start, end) not in found and layer[0] >> (4 * end + start) & 1:
                    found[start, end] = cost, _trace(codes, layers, start, end)
    return found


def _trace(codes: str, layers: list[list[int]], state: int, end: int) -> str:
    """The ASCII-least audit from ``state`` at the cost of the last layer."""
    cost, i, out = len(layers) - 1, 0, []
    inside = lambda less, j, q: cost >= less and layers[cost - less][j] >> (4 * end + q) & 1
    while i < len(codes) or cost or state != end:
        c = codes[i] if i < len(codes) else None
        extra = TRUNCATED if c is not None and c.isupper() else 0
        other = next(q for (p, x), q in NEXT.items() if p == state and x in "ua")
        if c is not None and inside(DELETE, i + 1, state):
            out.append("D")
            cost, i = cost - DELETE, i + 1
        elif inside(INSERT, i, other):
            out.append("I")
            cost, state = cost - INSERT, other
        elif (q := NEXT.get((state, c.lower()))) is not None and inside(extra, i + 1, q):
            out.append("K")
            cost, state, i = cost - extra, q, i + 1
        else:
            out.append("R")
            cost, state, i = cost - REROLE - extra, other, i + 1
    return "".join(out)


def joined(a: Table, b: Table) -> Table:
    """Two neighbours as one. Audits of equal cost over the same turns are never the beginning of one another, so the least of each part makes the least whole."""
    out: Table = {}
    for (start, mid), (cost, audit) in a.items():
        for end in range(STATES):
            if (rest := b.get((mid, end))) is not None:
                x = cost + rest[0], audit + rest[1]
                if (start, end) not in out or x < out[start, end]:
                    out[start, end] = x
    return out


def summed(codes: str) -> Table:
    """The table of any number of turns."""
    parts = [block(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)] or [block("")]
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def repaired(audit: str, state: int, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of what an audit leaves of the turns (role, text), from a state on."""
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == 2 else "u"]
        state = NEXT[state, role[:1]]
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows with the query's damage; a row that is dropped stays as gone, so that its conversation does.

    Nulls in role and text count as one space, those of conv_id and turn in what the damage hangs on only.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies)).drop("col")


def _fault(text: Column) -> Column:
    """``b`` for a blank text, ``t`` for a truncated one, or nothing."""
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(last == "", "b").when(~last.isin(*ENDS), "t").otherwise("")


_COUNTS = ("rows", "least", "most", "turns", "blank", "duplicate", "truncated", "illegal")


class _Piece:
    """What is counted of some turns of a conversation that follow each other, and their codes."""

    def __init__(self):
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.first = self.last = None
        self.codes: list[str] = []

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank, self.duplicate, self.truncated = self.blank + (fault == "b"), self.duplicate + (fault == "d"), self.truncated + (fault == "t")
        code = initial if initial in ("s", "u", "a") else "x"
        self.codes.append("-" if fault in ("b", "d") else code.upper() if fault == "t" else code)

    def counts(self) -> tuple:
        return tuple(getattr(self, c) for c in _COUNTS)


def _best(found: Table) -> tuple[int, str]:
    return min(found[0, e] for e in ACCEPT if (0, e) in found)


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"


def _whole(turns: list[tuple]) -> tuple:
    """The result of a conversation's turns (turn, role, text, fault) in order."""
    piece, seen = _Piece(), set()
    for turn, role, text, fault in turns:
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        piece.add(turn, role, "d" if mark in seen and fault != "b" else fault)
        seen.add(mark)
    cost, audit = _best(summed("".join(piece.codes)))
    sha = hashlib.sha256("\n".join(repaired(audit, 0, ((role, text) for _, role, text, _ in turns))).encode()).hexdigest()
    return _gaps(piece.least, piece.most, piece.turns), piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost, audit, sha


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (conv_id, conv, turn, role, text, gone, fault): results of conversations that are whole in here, rows of the first and the last as they are."""
    piece, runs, pos, now, out, held, conv = TaskContext.get().partitionId(), 0, 0, [], [], 0, None
    names = ["conv_id", "conv", "piece", "pos", "turn", "role", "text", "gone", "fault", *(x.split()[0] for x in _RESULT.split(", "))]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [kind, *kinds], strict=True)], names)

    for given in batches:
        kind = given.schema.field(0).type
        for part in slices(iter([given])):
            for id_, key, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != conv:
                    if runs > 1:
                        out.append((now[0][0], conv, *[None] * 7, *_whole([x[2:] for x in now if not x[1]])))
                    conv, runs, now, pos = key, runs + 1, [], 0
                if runs == 1:  # goes on from the range before, perhaps
                    out.append((id_, key, piece, pos, turn, role, text, gone, fault, *[None] * 8))
                    held += len(text)
                else:
                    now.append((id_, gone, turn, role, text, fault))
                pos += 1
                if len(out) >= 1000 or held > 4 << 20:
                    yield batch(out, kind)
                    out, held = [], 0
    if out:
        yield batch(out, kind)
    for at in range(0, len(now), 256):  # goes on in the range after, perhaps
        yield batch([(id_, conv, piece, at + i, turn, role, text, gone, fault, *[None] * 8) for i, (id_, gone, turn, role, text, fault) in enumerate(now[at : at + 256])], kind)


def _pieces(rows: pa.Table) -> pa.Table:
    """A row for the rows (conv, piece, pos, turn, role, fault) of a piece: what it counts, and the table of its turns."""
    rows = rows.sort_by("pos")
    one = _Piece()
    for turn, role, fault in zip(*(rows.column(c).to_pylist() for c in ("turn", "role", "fault")), strict=True):
        one.add(turn, role, fault)
    found = [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in summed("".join(one.codes)).items()]
    out = {"conv": rows.column("conv")[:1], "piece": rows.column("piece")[:1]} | {c: pa.array([x], pa.int64()) for c, x in zip(_COUNTS, one.counts(), strict=True)}
    out |= {"first": pa.array([one.first], pa.string()), "last": pa.array([one.last], pa.string()), "found": pa.array([found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))}
    return pa.table(out)


_PIECE = "conv string, piece long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first string, last string, found array<struct<start:int,end:int,cost:long,audit:string>>"


def _together(pieces: pa.Table) -> pa.Table:
    """A conversation's pieces put together: a row for each piece with its start and audit, and one without a piece for the whole."""
    rows = pieces.sort_by("piece").to_pylist()
    tables = [{(x["start"], x["end"]): (x["cost"], x["audit"]) for x in r["found"]} for r in rows]
    rest: list[dict[int, tuple[int, str]]] = [{q: (0, "") for q in ACCEPT}]  # from each state on, all pieces after
    for t in reversed(tables):
        now: dict[int, tuple[int, str]] = {}
        for (start, end), (cost, audit) in t.items():
            if end in rest[-1]:
                x = cost + rest[-1][end][0], audit + rest[-1][end][1]
                now[start] = min(x, now.get(start, x))
        rest.append(now)
    rest.reverse()
    state, parts = 0, []
    for k, t in enumerate(tables):
        end = next(e for (s, e), (c, a) in t.items() if s == state and e in rest[k + 1] and (c + rest[k + 1][e][0], a + rest[k + 1][e][1]) == rest[k][state])
        parts.append((rows[k]["piece"], state, t[state, end][1]))
        state = end
    seams = list(zip(rows, rows[1:], strict=False))
    turns = [r for r in rows if r["least"] is not None]
    distinct = sum(r["turns"] for r in turns) - sum(a["most"] == b["least"] for a, b in zip(turns, turns[1:], strict=False))
    gaps = _gaps(turns[0]["least"] if turns else None, turns[-1]["most"] if turns else None, distinct)
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in seams)
    total = (gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, rest[0][0][0])
    conv = rows[0]["conv"]
    out = [(conv, p, s, *[None] * 6, a) for p, s, a in parts] + [(conv, None, None, *total, rest[0][0][1])]
    names = ["conv", "piece", "state", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pa.table({n: pa.array(c, pa.string() if n in ("conv", "audit") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})


_TOGETHER = "conv string, piece long, state long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _left(rows: pa.Table) -> pa.Table:
    """The repaired lines of a piece's rows (conv, piece, pos, role, text, state, audit)."""
    rows = rows.sort_by("pos")
    lines = list(repaired(rows.column("audit")[0].as_py(), rows.column("state")[0].as_py(), zip(*(rows.column(c).to_pylist() for c in ("role", "text")), strict=True)))
    n = len(lines)
    return pa.table({"conv": pa.array([rows.column("conv")[0].as_py()] * n, pa.string()), "piece": pa.array([rows.column("piece")[0].as_py()] * n, pa.int64()), "pos": pa.array(range(n), pa.int64()), "line": pa.array(lines, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, sha) of lines that come sorted by conversation."""
    conv = sha = None
    out: list[tuple[str, str]] = []
    for batch in batches:
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != conv:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.encode())
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], ["conv", "sha"])
            out = []
    if sha is not None:
        out.append((conv, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], ["conv", "sha"])


def _parted(rows: DataFrame) -> DataFrame:
    """conv and the result of conversations whose written rows (conv, piece, pos, turn, role, text, gone, fault) lie in pieces."""
    rows = rows.filter("not gone").withColumn("mark", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    first = rows.filter("fault <> 'b'").groupBy("conv", "mark").agg(F.min(F.struct("piece", "pos")).alias("met"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first, "met", narrow=True)
    again = F.col("met").isNotNull() & (F.col("met") != F.struct("piece", "pos")) & (F.col("fault") != "b")
    faulty = written(attach(rows, first, ["conv", "mark"], "left", "n").withColumn("fault", F.when(again, "d").otherwise(F.col("fault"))).drop("mark", "met", "n"), "faults")
    pieces = written(faulty.select("conv", "piece", "pos", "turn", "role", "fault").groupBy("conv", "piece").applyInArrow(_pieces, _PIECE), "pieces", narrow=True)
    whole = written(pieces.groupBy("conv").applyInArrow(_together, _TOGETHER), "together", narrow=True)
    audits = whole.filter("piece is not null").select("conv", "piece", "state", "audit")
    lines = faulty.select("conv", "piece", "pos", "role", "text").join(audits, ["conv", "piece"]).groupBy("conv", "piece").applyInArrow(_left, "conv string, piece long, pos long, line string")
    shas = written(lines.repartition("conv").sortWithinPartitions("conv", "piece", "pos").select("conv", "line").mapInArrow(_hashed, "conv string, sha string"), "shas", narrow=True)
    return whole.filter("piece is null").drop("piece", "state").join(shas, "conv", "left")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Turns stand in the order of turn (nulls first), then role, then text; rows that are gone only name their conversation,
    and one without any other row has zeros, an empty audit and the hash of an empty text. conv_id is of any type with an
    order; null is a conversation of its own. Roles other than those that begin with s, u or a, an empty one too, can't be
    kept. Empty input gives an empty result; other columns are not looked at. A conversation's turns are cut where ranges
    end, so a task holds no more than a range of them; only its audit is one value, and its repaired text is hashed as a
    stream. Rows that share conversation, turn, role and the first PREFIX characters of the text stay in one range.
    """
    rows = rows.select("conv_id", id_text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone", _fault(F.col("text")).alias("fault"))
    order = ["conv", F.asc_nulls_first("turn"), "role"]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    id_kind = rows.schema["conv_id"].dataType.simpleString()
    found = written(ranged.mapInArrow(_repair, f"conv_id {id_kind}, conv string, piece long, pos long, turn long, role string, text string, gone boolean, fault string, {_RESULT}"), "repaired")
    columns = [x.split()[0] for x in _RESULT.split(", ")]
    open_ = found.filter("piece is not null")
    parted = _parted(open_.select("conv", "piece", "pos", "turn", "role", "text", "gone", "fault"))
    ids = open_.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    zero = {c: F.coalesce(c, F.lit("") if c in ("audit", "sha") else F.lit(0).cast("long")) for c in columns}
    zero["sha"] = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))
    out = found.filter("piece is null").select("conv_id", *columns).union(ids.join(parted, "conv", "left").select("conv_id", *columns))
    return out.withColumns(zero).withColumnRenamed("sha", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE: dict[str, str] = {}
