"""Arithmetic of rules: ``+ - * / **``, signs, parentheses, fields with subscripts.

An expression becomes a small tree once, on the driver; both the Spark compiler and the plain
evaluator walk that tree. Powers bind to the right; their exponents are whole numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

_TOKEN = re.compile(r"\s*(?:(?P<op>\*\*|[-+*/()])|(?P<num>\d+(?:\.\d+)?|\.\d+)(?![A-Za-z0-9_-])|(?P<name>[A-Za-z0-9][A-Za-z0-9_-]*(?:\([^()]*\))?))")
#: Text that is arithmetic and not a name: an operator between spaces, a power, a parenthesis or a function.
LOOKS_LIKE = re.compile(r"\s[-+*/]\s|\*\*|^\(|^FUNCTION ")


class ExpressionError(ValueError):
    """An expression that can't be read."""


@dataclass(frozen=True)
class Node:
    """``op`` is num, name, neg, or one of + - * / **."""

    op: str
    args: tuple[Node, ...] = ()
    value: Decimal | None = None
    name: str = ""


_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "**": 3}


@lru_cache(4096)
def parse(text: str) -> Node:
    """The tree of an expression, by precedence climbing."""
    tokens: list[tuple[str, str]] = []
    at, text = 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text!r} at {at}")
        tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    here = 0

    def now() -> tuple[str, str]:
        return tokens[here] if here < len(tokens) else ("", "")

    def operand() -> Node:
        nonlocal here
        kind, value = now()
        here += 1
        if kind == "num":
            return Node("num", value=Decimal(value))
        if kind == "name":
            return Node("name", name=value)
        if value in ("+", "-"):
            inner = operand()
            return inner if value == "+" else Node("neg", (inner,))
        if value == "(":
            inner = climb(1)
            if now()[1] != ")":
                raise ExpressionError(f"missing ) in {text!r}")
            here += 1
            return inner
        raise ExpressionError(f"operand expected in {text!r}")

    def climb(least: int) -> Node:
        nonlocal here
        left = operand()
        while now()[0] == "op" and _RANK.get(now()[1], 0) >= least:
            op = now()[1]
            here += 1
            left = Node(op, (left, climb(_RANK[op] + (op != "**"))))
        return left

    out = climb(1)
    if here != len(tokens):
        raise ExpressionError(f"{text!r} goes on after its end")
    return out


def names(node: Node) -> list[str]:
    """Fields that the expression reads, in order."""
    return [node.name] if node.op == "name" else [n for a in node.args for n in names(a)]
