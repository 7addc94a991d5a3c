"""Faults put into rules, and the rows of a table that show them.

A fault changes one place of a rule: a comparison that always or never holds, a literal of it one step up or
down, a write that is lost. All faults of a rule are listed, none is drawn, so a report on them is the same
each time. Scoring is by bits: a rule's condition and those of all its faulty versions are boolean columns of one
projection over the table, and an aggregate counts the rows on which they differ.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.plans.compile import Scope, condition
from edictum.plans.ir import Condition, Rule

#: Faulty versions in one projection.
BATCH = 200


@dataclass(frozen=True)
class Fault:
    """``kind`` at ``place`` (a path of group keys and positions, or the position of an action), and the rule that has it."""

    kind: str
    place: str
    rule: Rule


def _step(v: Any) -> Any:
    """The least step of a number as it is written."""
    return 1 if isinstance(v, int) else float(Decimal(1).scaleb(Decimal(str(v)).as_tuple().exponent))


def _moved(v: Any, sign: int) -> Any:
    return v + sign if isinstance(v, int) else float(Decimal(str(v)) + sign * Decimal(str(_step(v))))


def _of_leaf(c: Condition) -> Iterator[tuple[str, Condition]]:
    """Faulty versions of one comparison."""
    yield "holds always", {"all": []}
    yield "holds never", {"any": []}
    value = c.get("value")
    several = isinstance(value, (list, tuple))
    for i, v in enumerate(value if several else [value]):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            for sign, name in ((1, "up"), (-1, "down")):
                other = _moved(v, sign)
                yield f"literal {i + 1} {name}", {**c, "value": [*value[:i], other, *value[i + 1 :]] if several else other}


def _versions(c: Condition, place: str) -> Iterator[tuple[str, str, Condition]]:
    """Kind, place and condition for each fault of a condition."""
    for k in ("all", "any"):
        if c.get(k) is not None:
            for i, part in enumerate(c[k]):
                for kind, at, other in _versions(part, f"{place}/{k}{i + 1}"):
                    yield kind, at, {k: [*c[k][:i], other, *c[k][i + 1 :]]}
            return
    if c.get("not") is not None:
        for kind, at, other in _versions(c["not"], f"{place}/not"):
            yield kind, at, {"not": other}
        return
    for kind, other in _of_leaf(c):
        yield kind, place or "/", other


def faults_of(rule: Rule) -> list[Fault]:
    """All faults of a rule's own condition and of its writes."""
    out = [Fault(kind, at, rule.with_(conditions=c)) for kind, at, c in _versions(rule.conditions, "")]
    out += [Fault("lost write", str(i + 1), rule.with_(actions=(*rule.actions[:i], *rule.actions[i + 1 :]))) for i, a in enumerate(rule.actions) if a.writes]
    return out


def _sums(df: DataFrame, rows: list[tuple[str, str, str, Column]]) -> DataFrame:
    """A row for each of ``rows`` (rule, kind, place, bit) with the number of rows of ``df`` on which the bit is set."""
    held = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(bit).alias(f"b{i}") for i, (*_, bit) in enumerate(rows)))
    each = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(k).alias("kind"), F.lit(p).alias("place"), F.col(f"b{i}").alias("seen")) for i, (r, k, p, _) in enumerate(rows)))
    return held.select("n", F.explode(each).alias("f")).select("f.*", "n")


def seen_on(df: DataFrame, rules: Iterable[Rule], bindings: Mapping[str, str | Column] | None = None) -> DataFrame:
    """``rule_id``, ``kind``, ``place``, ``seen`` (rows on which the faulty rule acts otherwise) and ``n`` (all rows) of every fault.

    A fault of a condition is seen where it makes the rule fire or not, a lost write where the rule fires. Rules are judged one by one, in
    their contexts. An empty table sees nothing. The table is read once for each BATCH faults.
    """
    scope, bits = Scope.of(df, bindings), []
    for r in rules:
        fires = condition(r.effective(), scope)
        for f in faults_of(r):
            bits.append((r.rule_id, f.kind, f.place, fires if f.kind == "lost write" else fires != condition(f.rule.effective(), scope)))
    if not bits:
        return df.sparkSession.createDataFrame([], "rule_id string, kind string, place string, seen bigint, n bigint")
    parts = [_sums(df, bits[at : at + BATCH]) for at in range(0, len(bits), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def shares(seen: DataFrame) -> DataFrame:
    """For each rule: faults, those that some row shows, and their share."""
    return seen.groupBy("rule_id").agg(F.count(F.lit(1)).alias("faults"), F.count_if(F.col("seen") > 0).alias("shown"), F.avg((F.col("seen") > 0).cast("double")).alias("share"))
