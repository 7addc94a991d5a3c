"""Canonical keys: two rules with the same key mean the same."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

from edictum.plans.ir import Action, Condition, Rule

#: The relation that holds where another doesn't, and the one with its sides swapped.
NEGATED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
FLIPPED = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
_NUMBER = re.compile(r"[+-]*\d+\.?\d*|[+-]*\d*\.\d+")


def decimal_text(v: Any) -> str:
    """A number without zeros at its end."""
    d = Decimal(str(v))
    return "0" if not d else format(d.normalize(), "f")


def literal_key(v: Any, typed: bool = False) -> str:
    """``n:`` and a number, or ``s:`` and text. Text that reads as a number is one unless ``typed``."""
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return "n:" + decimal_text(v)
    text = str(v)
    return "n:" + decimal_text(text.strip()) if not typed and not isinstance(v, bool) and _NUMBER.fullmatch(text.strip()) and text.strip().count("+") + text.strip().count("-") <= 1 else "s:" + text.rstrip()


def plain(c: Condition) -> Condition:
    """Only relations and class tests: in, not_in and between are written out."""
    for k in ("all", "any"):
        if c.get(k) is not None:
            return {k: [plain(x) for x in c[k]]}
    if c.get("not") is not None:
        return {"not": plain(c["not"])}
    part = lambda op, v: {**c, "op": op, "value": v}
    if c["op"] == "in":
        return {"any": [part("==", v) for v in c["value"]]}
    if c["op"] == "not_in":
        return {"all": [part("!=", v) for v in c["value"]]}
    if c["op"] == "between":
        return {"all": [part(">=", c["value"][0]), part("<=", c["value"][1])]}
    return c


def pushed(c: Condition, negate: bool = False) -> Condition:
    """Negations only on class tests: elsewhere they turn groups and relations around."""
    if c.get("not") is not None:
        return pushed(c["not"], not negate)
    for k, other in (("all", "any"), ("any", "all")):
        if c.get(k) is not None:
            return {other if negate else k: [pushed(x, negate) for x in c[k]]}
    if not negate:
        return c
    return {**c, "op": NEGATED[c["op"]]} if c["op"] in NEGATED else {"not": c}


def _structure(c: Condition, typed: bool) -> Any:
    for k in ("all", "any"):
        if c.get(k) is not None:
            parts: dict[str, Any] = {}
            for x in c[k]:
                s = _structure(x, typed)
                for y in s[1] if isinstance(s, list) and s[0] == k else [s]:
                    parts[json.dumps(y)] = y
            ordered = [parts[y] for y in sorted(parts)]
            return ordered[0] if len(ordered) == 1 else [k, ordered]
    if c.get("not") is not None:
        return ["not", [_structure(c["not"], typed)]]
    right = "ref:" + str(c["ref"]).upper() if c.get("ref") else literal_key(c["value"], typed) if c.get("value") is not None else ""
    return f"{str(c.get('source_name') or c.get('field', '')).upper().strip()} {c['op']} {right}"


def condition_key(c: Condition, typed: bool = False) -> str:
    """A string that equal conditions share."""
    return json.dumps(_structure(pushed(plain(c)), typed))


def expression_key(text: str) -> str:
    """Upper case, no white space, no unary plus."""
    return re.sub(r"(^|[-+*/(=])\+", r"\1", re.sub(r"\s+", "", text.upper()))


def action_key(a: Action) -> tuple[str, str, str]:
    """Type, target and value."""
    right = "expr:" + expression_key(a.expr) if a.expr else literal_key(a.value) if a.value is not None else ""
    return a.type, str(a.source_name or a.target or "").upper(), right


def actions_key(actions: tuple[Action, ...]) -> str:
    """Actions in any order."""
    return json.dumps(sorted(map(action_key, actions)))


def rewrites_a_target(actions: tuple[Action, ...]) -> bool:
    """Whether two actions write one target, so that their order matters though the key forgets it."""
    targets = [str(a.source_name or a.target) for a in actions if a.writes]
    return len(set(targets)) < len(targets)


def rule_key(r: Rule) -> str:
    """Condition, actions and else-actions."""
    return "\n".join([condition_key(r.conditions), actions_key(r.actions), actions_key(r.else_actions)])


def disjuncts(c: Condition, most: int) -> list[list[Condition]] | None:
    """The condition as alternatives of conjunctions; None if there are more than ``most``."""

    def go(c: Condition) -> list[list[Condition]] | None:
        if c.get("all") is not None:
            out: list[list[Condition]] = [[]]
            for x in c["all"]:
                part = go(x)
                if part is None or len(out) * len(part) > most:
                    return None
                out = [a + b for a in out for b in part]
            return out
        if c.get("any") is not None:
            parts = [go(x) for x in c["any"]]
            out = [y for p in parts if p is not None for y in p]
            return None if any(p is None for p in parts) or len(out) > most else out
        return [[c]]

    return go(pushed(plain(c)))
