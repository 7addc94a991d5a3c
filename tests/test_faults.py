"""Faults counted by bits against plain evaluation row by row."""

import random

from edictum.operators import faults
from edictum.plans.evaluate import holds
from edictum.plans.ir import Action, Rule, leaf

RULES = [
    Rule("A", {"all": [leaf("X", "between", [2, 5]), {"any": [leaf("T", "in", ["a", "b"]), {"not": leaf("X", ">", 3)}]}]}, (Action("set", "o", "O", "1"), Action("perform", "p"))),
    Rule("B", leaf("Y", ">=", 0.25), (Action("set", "o", "O", "1"), Action("compute", "q", "Q", expr="X + 1")), context=leaf("X", "<", 4)),
]


def test_counts_against_rows(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [{"X": rnd.choice([None, 0, 1, 2, 3, 4, 5, 6]), "Y": rnd.choice([None, 0.0, 0.24, 0.25, 0.26, 1.0]), "T": rnd.choice(["a", "b", "c", None])} for _ in range(200)]
    df = spark.createDataFrame([(r["X"], r["Y"], r["T"]) for r in rows], "X int, Y double, T string")
    for batch in (faults.BATCH, 3):
        monkeypatch.setattr(faults, "BATCH", batch)
        got = {(r.rule_id, r.kind, r.place): (r.seen, r.n) for r in faults.seen_on(df, RULES).collect()}
        want = {}
        for rule in RULES:
            for f in faults.faults_of(rule):
                lost = f.kind == "lost write"
                want[rule.rule_id, f.kind, f.place] = (sum(holds(rule.effective(), r) if lost else holds(rule.effective(), r) != holds(f.rule.effective(), r) for r in rows), 200)
        assert got == want and len(got) > 15


def test_literals_move_by_a_step_of_their_own():
    kinds = {(f.kind, f.rule.conditions.get("value")) for f in faults.faults_of(RULES[1]) if f.kind.startswith("literal")}
    assert kinds == {("literal 1 up", 0.26), ("literal 1 down", 0.24)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "X int, Y double, T string")
    assert {(r.seen, r.n) for r in faults.seen_on(none, RULES).collect()} == {(0, 0)}
    assert faults.seen_on(none, []).collect() == []
    got = {r.rule_id: (r.faults, r.shown, r.share) for r in faults.shares(faults.seen_on(none, RULES)).collect()}
    assert got["B"] == (6, 0, 0.0)
