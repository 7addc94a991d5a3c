"""Shapley values against their definition, over all orders of the inputs."""

import itertools
import random

import pytest

from edictum.operators import explain
from edictum.plans.evaluate import decide
from edictum.plans.ir import Action, Rule, leaf

BASE = {"A": 0, "B": 1, "T": "x"}
RULES = [
    Rule("R1", {"all": [leaf("A", ">", 1), leaf("T", "==", "y")]}, (Action("set", "out", "OUT", 5),)),
    Rule("R2", {"any": [leaf("B", ">", 2), leaf("A", "==", 3)]}, (Action("set", "out", "OUT", 9),)),
    Rule("R3", {"all": [leaf("K", "==", 1), leaf("B", "<", 1)]}, (Action("set", "out", "OUT", 2),)),
]


def by_orders(row, got):
    """Mean of what each input adds, over all orders in which inputs come in."""
    effects, orders = dict.fromkeys(BASE, 0.0), list(itertools.permutations(BASE))
    for order in orders:
        now = {**BASE, "K": row["K"]}
        before = got(now)
        for f in order:
            now = {**now, f: row[f]}
            effects[f] += (got(now) - before) / len(orders)
            before = got(now)
    return effects, before, got({**BASE, "K": row["K"]})


@pytest.mark.parametrize("value", [None, "9"])
def test_against_all_orders(spark, value):
    rnd = random.Random(4)
    rows = [{"id": i, "A": rnd.choice([None, 0, 2, 3]), "B": rnd.choice([0, 1, 3]), "T": rnd.choice(["x", "y", None]), "K": rnd.choice([0, 1])} for i in range(40)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, A int, B int, T string, K int")

    def got(state):
        out = decide(RULES, state, {"OUT": 1})[0].get("out")
        return float(out or 0) if value is None else float(str(out) == value)

    found = explain.shapley(df, "id", RULES, "out", BASE, {f: f for f in ("A", "B", "T", "K")}, value, {"OUT": 1}).collect()
    assert len(found) == 3 * len(rows)
    for r in rows:
        effects, score, base = by_orders(r, got)
        mine = {f.field: f for f in found if f.id == r["id"]}
        assert all(abs(mine[f].effect - effects[f]) < 1e-9 and (mine[f].score, mine[f].base) == (score, base) for f in BASE)
        assert abs(sum(m.effect for m in mine.values()) - (score - base)) < 1e-9


def test_importance_and_bounds(spark):
    df = spark.createDataFrame([(1, 3, 1, "x", 0)], "id long, A int, B int, T string, K int")
    effects = explain.shapley(df, "id", RULES, "out", BASE, {f: f for f in ("A", "B", "T", "K")})
    assert {r.field: r.share for r in explain.importance(effects).collect()} == {"A": 1.0, "B": 0.0, "T": 0.0}
    assert explain.importance(effects.limit(0)).collect() == []
    with pytest.raises(ValueError):
        explain.shapley(df, "id", RULES, "out", {}, {})
