"""Repair against a plain search for the cheapest, ASCII-least edits, over suffixes."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edictum.llm import conversation_repair as cr
from edictum.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
WAYS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(faults, roles):
    """(cost, audit) by recursion from the end; ``faults`` has '', 'cut' or 'go' for each row."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        if i == len(roles) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            for r in WAYS[state].replace("s", ""):
                c, s = best(i, r, inserts + 1)
                found.append((c + 5, "I" + s))
        if i < len(roles):
            c, s = best(i + 1, state, 0)
            found.append((c + 2, "D" + s))
            if faults[i] != "go":
                more = 5 if faults[i] == "cut" else 0
                for r in WAYS[state]:
                    c, s = best(i + 1, r, 0)
                    if roles[i][:1] == r:
                        found.append((c + more, "K" + s))
                    if r != "s":
                        found.append((c + 1 + more, "R" + s))
        return min(found) if found else (10**9, "")

    return best(0, "", 0)


def brute(rows, damage=True):
    """What op13 returns for each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
            mine += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            said = text.strip(BLANK)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faults.append({"": "", "truncated": "cut"}.get(fault, "go"))
        cost, audit = cheapest(tuple(faults), tuple(r[1] for r in mine))
        kept, at = [], iter(mine)
        for x in audit:
            _, role, text = (0, "", "") if x == "I" else next(at)
            if x in "IR":
                role = "assistant" if kept and kept[-1][0][:1] == "u" else "user"
            if x != "D":
                kept.append((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def query_of(spark, rows, tmp_path, name="in"):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = op13_conversation_repair(spark, f"{tmp_path}/{name}").collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


ROLES = ["user", "assistant", "system", "tool", "", "Ua", None]
TEXTS = ["ok.", "ok", "", " \n", "no!", "why?", "é.", None, "a. \t", "x"]


def some_rows(n, convs, seed, turns=9):
    rnd = random.Random(seed)
    return [(rnd.choice(convs), rnd.choice([None, *range(-2, turns)]), rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(n)]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from(["", "cut", "go"])), max_size=9))
@settings(max_examples=400, deadline=None)
def test_walk_spells_the_least_of_the_cheapest(rows):
    bits = {"": 0, "cut": cr.CUT, "go": cr.MUST}
    codes = [cr.KINDS.find(r[0]) % 4 | bits[f] for r, f in rows]
    walk = cr.Walk(codes, list(cr.FIRST), list(cr.LAST))
    assert (walk.total, walk.spell(1, True)) == cheapest(tuple(f for _, f in rows), tuple(r for r, _ in rows))


def test_query_against_brute_force(spark, tmp_path):
    rows = some_rows(600, [None, *range(60)], 5) + [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(100, 160) for t in range(6)]
    assert query_of(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows_a_segment", [1, 3])
def test_cut_conversations(spark, rows_a_segment):
    """A third of all rows in one conversation, in ranges and segments of a few rows."""
    rows = some_rows(150, [7], 11, turns=200) + some_rows(200, list(range(20, 60)), 12) + [(7, 500, "user", "again.")] * 9
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repaired, counts = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA), rows_a_segment)
        got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) for r in counts.collect()}
        said = {r.conv_id: (r.audit, r.repaired_sha256) for r in cr.digests(repaired).collect()}
        assert {c: got[c] + said[c] for c in got} == brute(rows, damage=False)
        assert repaired.filter("conv_id = 7").count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_foreign_columns(spark, tmp_path):
    assert query_of(spark, [], tmp_path) == {}
    df = spark.createDataFrame([(1, 0, "user", "a.", 3, 4), (1, 1, "assistant", "b.", 5, 6)], SCHEMA + ", said long, first long")
    repaired, counts = cr.repair_conversations(df)
    assert [(r.audit, r.roles, r.texts) for r in repaired.collect()] == [("KK", ["user", "assistant"], ["a.", "b."])]
    assert [(r.conv_id, r.gaps, r.cost) for r in counts.collect()] == [(1, 0, 0)]


def test_long_texts_and_extreme_turns(spark, tmp_path):
    rows = [(3, -(2**63), "user", "x" * 700_000 + "."), (3, 2**63 - 1, "assistant", "y" * 700_000 + "!"), (3, 0, "system", "z. ")]
    got, want = query_of(spark, rows, tmp_path)[3], brute(rows)[3]
    assert want[0] > got[0] == 2**63 - 1 and got[1:] == want[1:]
