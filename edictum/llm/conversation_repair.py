"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

Rows of a conversation, in order, are edited by Keep, Rerole, Delete and Insert until the initials
of their roles read ``(s?(ua)+)?``. A node is a place between rows with a state of that pattern, an
arc is an edit. Minimum costs from the start and to the end mark the arcs that lie on some
cheapest way (tight arcs). A walk over sets of nodes (frontiers) takes the least letter that leaves
the frontier by a tight arc, so it spells the ASCII-least of all cheapest edits.

Rows are dealt out by ranges of (conversation, turn, role, start of the text), equal rows being one
row with a count, so that a conversation of any size is spread over tasks. A conversation that lies
inside a range is repaired there. One that is cut (into segments of bounded size) is repaired by
composing its segments: each gives the 4 x 4 matrix of its costs between states; products of them
from both ends give the costs at its bounds; then each gives what it makes of a frontier. (An edit's
letter and its row fix the state it leads to, so a frontier that begins with one state always has one.) Only
these small rows, one for some thousands of turns, meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.workspace import join_unevenly, materialize, materialize_counted
from edictum.shipping import ship_package

#: A segment ends with the row that takes it past so many rows or characters.
ROWS, CHARS = 4096, 1 << 18
#: States of the pattern: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KINDS = "sua"
#: A row's code: its kind (3: another role), and bits for a row that has to go and for one that is cut off.
MUST, CUT = 4, 8
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
_STEPS = ((NOTHING, SYSTEM), (NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
#: In this order one round over them settles costs from the start; backwards, costs to the end.
_INSERTS = tuple(("I", p, q, INSERT) for p, q in _STEPS[1:])


def _arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """The edits of a row: letter, state before, state after, cost."""
    out = [("D", p, p, DELETE) for p in range(4)]
    if not code & MUST:
        more = UNFINISHED if code & CUT else 0
        out += [("K", p, q, more) for p, q in _STEPS if code & 3 == q - 1]
        out += [("R", p, q, REROLE + more) for p, q in _STEPS if q != SYSTEM]
    return tuple(out)


ARCS = tuple(_arcs(code) for code in range(16))


def _forth(costs: list[int], arcs: tuple) -> list[int]:
    out = [NEVER] * 4
    for _, p, q, c in arcs:
        if costs[p] + c < out[q]:
            out[q] = costs[p] + c
    return out


def _back(costs: list[int], arcs: tuple) -> list[int]:
    out = [NEVER] * 4
    for _, p, q, c in arcs:
        if costs[q] + c < out[p]:
            out[p] = costs[q] + c
    return out


def _inserted(costs: list[int]) -> list[int]:
    for _, p, q, c in _INSERTS:
        if costs[p] + c < costs[q]:
            costs[q] = costs[p] + c
    return costs


def _insertable(costs: list[int]) -> list[int]:
    for _, p, q, c in reversed(_INSERTS):
        if costs[q] + c < costs[p]:
            costs[p] = costs[q] + c
    return costs


#: Costs before the first row, and costs still to come after the last.
FIRST, LAST = (0, NEVER, NEVER, NEVER), tuple(_insertable([0, NEVER, NEVER, 0]))


def costs_from(codes: list[int], first: list[int]) -> list[list[int]]:
    """Minimum costs at each place, inserts at that place included; the last entry is without them."""
    out, now = [], list(first)
    for code in codes:
        out.append(_inserted(now))
        now = _forth(now, ARCS[code])
    return [*out, now]


def costs_to(codes: list[int], last: list[int]) -> list[list[int]]:
    """Minimum costs from each place to the end."""
    out = [list(last)]
    for code in reversed(codes):
        out.append(_insertable(_back(out[-1], ARCS[code])))
    return out[::-1]


def matrix(codes: list[int]) -> list[int]:
    """Costs from each state before the rows to each after them, row by row."""
    return [x for p in range(4) for x in costs_from(codes, [0 if p == q else NEVER for q in range(4)])[-1]]


def _step(front: int, arcs: tuple, here: list[int], there: list[int], total: int, letter: str) -> tuple[str, int]:
    """The least letter up to ``letter`` of tight arcs out of the frontier (a set of states as bits), and the frontier it leads to."""
    to = 0
    for x, p, q, c in arcs:
        if front >> p & 1 and x <= letter and here[p] + c + there[q] == total:
            if x < letter:
                letter, to = x, 0
            to |= 1 << q
    return letter, to


class Walk:
    """Tight arcs of a segment."""

    def __init__(self, codes: list[int], first: list[int], last: list[int], total: int | None = None) -> None:
        self.codes, self.there = codes, costs_to(codes, last)
        self.here = costs_from(codes, first)
        self.here[-1] = _inserted(self.here[-1])
        self.total = min(a + b for a, b in zip(first, self.there[0])) if total is None else total

    def place(self, i: int, front: int) -> tuple[str, int]:
        """Letters from a frontier at place ``i`` up to and with the row there, and the frontier after it."""
        letters = ""
        while True:
            letter, to = _step(front, ARCS[self.codes[i]], self.here[i], self.there[i + 1], self.total, "Z")
            least, inserted = _step(front, _INSERTS, self.here[i], self.there[i], self.total, letter)
            if not inserted or least >= letter:
                return letters + letter, to
            letters, front = letters + least, inserted

    def end(self, front: int) -> str:
        """Letters after the last row: inserts until the pattern is complete."""
        letters, costs = "", self.here[-1]
        while not any(front >> p & 1 and costs[p] == self.total for p in (NOTHING, ASSISTANT)):
            letter, front = _step(front, _INSERTS, costs, self.there[-1], self.total, "Z")
            letters += letter
        return letters

    def spell(self, front: int, ends: bool) -> str:
        """All letters from a frontier before the first row."""
        out = []
        for i in range(len(self.codes)):
            letters, front = self.place(i, front)
            out.append(letters)
        return "".join(out) + (self.end(front) if ends else "")

    def frontiers(self) -> list[int]:
        """The frontier after the last row for each single state before the first; 0 where no cheapest way leads on."""
        now = [1 << s for s in range(4)]
        for i in range(len(self.codes)):
            after = {f: self.place(i, f)[1] for f in set(now) if f}
            now = [after.get(f, 0) for f in now]
        return now


def edited(letters: str, roles: list[str], texts: list[str], copies: list[int], after: int) -> tuple[list[str], list[str]]:
    """Repaired roles and texts of a segment; ``after`` is the state before it."""
    rows = ((r, t) for r, t, n in zip(roles, texts, copies) for _ in range(n))
    out_roles, out_texts = [], []
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        if x != "K":
            role = "assistant" if after == USER else "user"
        after = KINDS.index(role[0]) + 1
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def _expanded(codes: list[int], copies: list[int]) -> list[int]:
    """A code for each row; further copies of a row have to go."""
    return [x for code, n in zip(codes, copies) for x in (code, *[code | MUST] * (n - 1))]


_STAGE = "conv_id bigint, part int, seg int, whole boolean, audit string, roles array<string>, texts array<string>, codes array<int>, copies array<bigint>, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint, matrix array<bigint>"
_STRINGS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": _STRINGS, "array<int>": pa.list_(pa.int32()), "array<bigint>": _LONGS}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    rows.clear()
    return out


class _Segment:
    """Rows of a conversation that follow one another, and what is counted on them."""

    def __init__(self) -> None:
        self.roles, self.texts, self.copies, self.codes = [], [], [], []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        said, code = text.strip(BLANKS), KINDS.find(role[:1] or " ") % 4
        if not said:
            self.blank, code = self.blank + copies, code | MUST
        else:
            self.duplicate += copies - 1 + again
            if again:
                code |= MUST
            elif said[-1] not in ".!?":
                self.truncated, code = self.truncated + 1, code | CUT
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a role's initial twice is never legal
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.codes.append(code)
        self.chars += len(role) + len(text)

    def row(self, conv: int | None, part: int, seg: int, whole: bool) -> tuple:
        codes = _expanded(self.codes, self.copies)
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, self.roles[0][:1], self.roles[-1][:1], self.low, self.high, self.turns)
        if not whole:
            return (conv, part, seg, False, None, self.roles, self.texts, self.codes, self.copies, None, *counts, matrix(codes))
        walk = Walk(codes, list(FIRST), list(LAST))
        audit = walk.spell(1, ends=True)
        roles, texts = edited(audit, self.roles, self.texts, self.copies, NOTHING)
        return (conv, part, seg, True, audit, roles, texts, None, None, walk.total, *counts, None)


def _segments(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments; conversations inside the range are repaired, those that may go on in another one wait."""
    schema, rows, size = _schema(_STAGE), [], 0
    now, part, seg, held, inner = None, 0, 0, None, False
    for batch in batches:
        for conv, turn, role, text, copies, again, part in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if held is not None and conv != now:
                rows.append(held.row(now, part, seg, inner and seg == 0))
                size += held.chars
                held, seg, inner = None, 0, True
            elif held is not None and (len(held.roles) >= most_rows or held.chars >= CHARS):
                rows.append(held.row(now, part, seg, False))
                size += held.chars
                held, seg = None, seg + 1
            if held is None:
                now, held = conv, _Segment()
            while copies > most_rows:
                held.add(turn, role, text, most_rows, again)
                rows.append(held.row(now, part, seg, False))
                held, seg, copies, again = _Segment(), seg + 1, copies - most_rows, True
            held.add(turn, role, text, copies, again)
            if size > CHARS or len(rows) >= 1024:
                size = 0
                if rows:
                    yield _batch(rows, schema)
    if held is not None:
        rows.append(held.row(now, part, seg, False))
    if rows:
        yield _batch(rows, schema)


def _times(v: list[int], m: list[int]) -> list[int]:
    return [min(v[p] + m[4 * p + q] for p in range(4)) for q in range(4)]


def _onto(m: list[int], v: list[int]) -> list[int]:
    return [min(m[4 * p + q] + v[q] for q in range(4)) for p in range(4)]


def _by_conversation(df: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` gives rows for the rows of each conversation in order; a row is some thousands of turns."""
    schema, names = _schema(ddl), df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != now:
                    rows += run(held)
                    held = []
                now = row["conv_id"]
                held.append(row)
                if len(rows) >= 4096:
                    yield _batch(rows, schema)
        if held:
            rows += run(held)
        if rows:
            yield _batch(rows, schema)

    assert names[:3] == ["conv_id", "part", "seg"]
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(each, ddl)


_BOUNDS = "conv_id bigint, part int, seg int, first array<bigint>, last array<bigint>, total bigint, ends boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint"


def _bounds(held: list[dict]) -> list[tuple]:
    """Costs at the bounds of a conversation's segments; counts of rows and turns, with what lies across bounds."""
    first, last = [list(FIRST)], [list(LAST)]
    for row in held:
        first.append(_times(first[-1], row["matrix"]))
    for row in reversed(held):
        last.append(_onto(row["matrix"], last[-1]))
    last.reverse()
    out, tail, high = [], None, None
    for i, row in enumerate(held):
        illegal, turns = row["illegal"], row["turns"]
        if i and tail + row["head"] not in LEGAL:
            illegal += 1
        if row["low"] is not None:
            turns -= row["low"] == high
            high = row["high"]
        tail = row["tail"]
        out.append((row["conv_id"], row["part"], row["seg"], first[i], last[i + 1], last[0][0], i + 1 == len(held), row["blank"], row["duplicate"], row["truncated"], illegal, row["low"], row["high"], turns))
    return out


_FRONTS = "conv_id bigint, part int, seg int, front int"


def _fronts(held: list[dict]) -> list[tuple]:
    """The frontier before each segment of a conversation."""
    out, front = [], 1 << NOTHING
    for row in held:
        out.append((row["conv_id"], row["part"], row["seg"], front))
        front = row["frontiers"][front.bit_length() - 1]
    return out


_KEYS = ["part", "seg", "conv_id"]


def _met(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Joined by segment. A range and a number in it and its conversation are one segment, so no key is hot."""
    there = other.select(*(F.col(c).alias(f"{c}_") if c in _KEYS else F.col(c) for c in other.columns))
    on = (F.col("part") == F.col("part_")) & (F.col("seg") == F.col("seg_")) & F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    return rows.join(there, on).drop(*(f"{c}_" for c in _KEYS))


def _composed(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of cut conversations, repaired; and their counts."""
    bounds = materialize(_by_conversation(cut.select(*_KEYS[2:], "part", "seg", "matrix", "head", "tail", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"), _bounds, _BOUNDS), "bounds")
    ways = bounds.select("conv_id", "part", "seg", "first", "last", "total", "ends")
    maps = "conv_id bigint, part int, seg int, frontiers array<int>"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(maps)
        for batch in batches:
            rows = [(r["conv_id"], r["part"], r["seg"], Walk(_expanded(r["codes"], r["copies"]), r["first"], r["last"], r["total"]).frontiers()) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows, schema)

    small = _met(cut.select("conv_id", "part", "seg", "codes", "copies"), ways).drop("ends")
    fronts = materialize(_by_conversation(small.mapInArrow(mapped, maps), _fronts, _FRONTS), "fronts")

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(REPAIRED)
        for batch in batches:
            for r in batch.to_pylist():
                audit = Walk(_expanded(r["codes"], r["copies"]), r["first"], r["last"], r["total"]).spell(r["front"], r["ends"])
                roles, texts = edited(audit, r["roles"], r["texts"], r["copies"], r["front"].bit_length() - 1)
                yield _batch([(r["conv_id"], r["part"], r["seg"], audit, roles, texts)], schema)

    met = _met(_met(cut.select("conv_id", "part", "seg", "roles", "texts", "codes", "copies"), ways), fronts)
    return met.mapInArrow(spelt, REPAIRED), bounds.select("conv_id", F.col("total").alias("cost"), *_COUNTS)


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
REPAIRED = "conv_id bigint, part int, seg int, audit string, roles array<string>, texts array<string>"


def repair_conversations(turns: DataFrame, segment_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Repaired segments of conversations, and a row of counts for each conversation.

    ``turns`` has conv_id, turn, role, text; other columns are left out. Rows are in the order of turn (nulls first), then
    role, then text. Null roles and texts are one space; a null conv_id is a conversation of its own. Equal rows are
    repeated rows. A row is blank without any character but white space, else a duplicate if its role and text
    came before, else truncated if its last such character is none of ``.!?``. Blank rows and duplicates
    have to go; a truncated row that stays costs 5. Empty texts are blank; texts of any length are read
    whole, each in one task. An empty table gives no rows. ``copies``, if there is such a column, tells how often a row
    stands there.

    Segments have conv_id, part, seg (their order), audit (K, R, D or I for each edit), roles and
    texts of what stays. Counts have conv_id, gaps (turns missing between the least and the greatest, 2^63 - 1 at most), blank,
    duplicate, truncated, illegal (neighbours whose roles may not follow one another, before the repair) and cost.
    """
    ship_package(turns.sparkSession)
    blank = F.lit(" ")
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text"))]
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.select(*cols, copies.alias("copies")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows, total = materialize_counted(rows.withColumn("said", F.sha2(told, 256)), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("weight"))
    marked = join_unevenly(rows, first, ["said"], "weight", total).withColumn("again", F.col("first") != place)
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv_id", "turn", "role", "text")
    stage = materialize(dealt.select("conv_id", "turn", "role", "text", "copies", "again", F.spark_partition_id().alias("part")).mapInArrow(lambda batches: _segments(batches, segment_rows), _STAGE), "segments", "zstd")
    whole = stage.filter("whole")
    composed, counts = _composed(stage.filter("not whole"))
    repaired = whole.select("conv_id", "part", "seg", "audit", "roles", "texts").unionByName(composed)
    counted = whole.select("conv_id", "cost", *_COUNTS).unionByName(counts).groupBy("conv_id")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    missing = F.coalesce(F.max("high").cast("decimal(38,0)") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    gaps = F.least(missing, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return repaired, counted.agg(gaps.alias("gaps"), *sums, F.max("cost").alias("cost"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn; ``copies`` tells how often a row stands there.

    A twentieth each is dropped, emptied, stripped of ``.!?``, repeated, or given to the user. Nulls are one space.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20
    kept = turns.filter(fault != 0)
    return kept.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text[2]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text[3], "[.!?]", "")).otherwise(text[3]).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """Audit and digest of each conversation's repaired rows: conv_id, audit, repaired_sha256.

    The digest is sequential, so a conversation's segments pass through one task, one at a time.
    """
    ddl = "conv_id bigint, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, now, state = _schema(ddl), [], None, None
        for batch in batches:
            for conv, audit, roles, texts in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, "".join(state[0]), state[1].hexdigest()))
                    now, state = conv, [[], hashlib.sha256(), False]
                state[0].append(audit)
                for role, text in zip(roles, texts):
                    state[1].update(f"{chr(10) if state[2] else ''}{role}:{text}".encode())
                    state[2] = True
            if len(rows) >= 4096:
                yield _batch(rows, schema)
        if state is not None:
            rows.append((now, "".join(state[0]), state[1].hexdigest()))
        if rows:
            yield _batch(rows, schema)

    ship_package(repaired.sparkSession)
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(run, ddl)
