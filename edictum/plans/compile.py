"""Compiling rules to Spark columns.

Types are settled on the driver: a number compares with a number as numbers, text with text as
text without blanks at the end, and text with a number as numbers where the text can be read as
one. Every leaf is two-valued: with a missing operand it is false (``missing="false"``), or, for
comparison with systems that see the word ``None`` there, that word is compared
(``missing="none-text"``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictum.functions import pic
from edictum.plans import arithmetic
from edictum.plans.ir import Action, Condition, Rule, base_name, outputs

NUM, TEXT = "num", "text"
_ZERO = "decimal(38,10)"


def as_number(v: Any) -> Decimal | None:
    """A literal as a number; blank text is 0."""
    if isinstance(v, bool) or v is None:
        return None
    try:
        return Decimal(str(v).strip() or "0")
    except InvalidOperation:
        return None


def number_literal(d: Decimal) -> Column:
    """An exact decimal literal, as narrow as it can be."""
    _, digits, exponent = d.as_tuple()
    scale = max(0, -exponent)
    return F.lit(format(d, "f")).cast(T.DecimalType(max(1, min(38, max(len(digits) + max(0, exponent), scale))), scale))


@dataclass(frozen=True)
class Value:
    """A compiled operand; ``literal`` if it is known on the driver."""

    column: Column
    kind: str
    literal: Any = None

    def text(self) -> Column:
        """As compared text."""
        return F.rtrim(self.column.cast("string"))

    def number(self) -> Column:
        """As a number, null if it can't be read."""
        return self.column if self.kind == NUM else pic.to_number(self.column)


def literal(v: Any) -> Value:
    """A literal operand."""
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return Value(number_literal(Decimal(str(v))), NUM, v)
    return Value(F.lit(str(v)), TEXT, str(v))


@dataclass
class Scope:
    """The state of a row: columns by field name, with their kinds; arrays for fields that occur."""

    values: dict[str, Value]
    missing: str = "false"
    arrays: dict[str, Value] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, bindings: Mapping[str, str | Column] | None = None, missing: str = "false") -> Scope:
        """Fields bound to columns: by name, or as columns, whose types Spark tells; without bindings every column is a field."""
        bound = {base_name(k): (F.col(v) if isinstance(v, str) else v) for k, v in (bindings or {c.upper().replace("_", "-"): F.col(f"`{c}`") for c in df.columns}).items()}
        names = list(bound)
        kinds = [f.dataType for f in df.select(*(bound[n].alias(f"c{i}") for i, n in enumerate(names))).schema] if names else []
        scope = cls({}, missing)
        for n, t in zip(names, kinds):
            scope.put(n, bound[n], t)
        return scope

    def put(self, name: str, column: Column, kind: T.DataType) -> None:
        """Bind a field."""
        if isinstance(kind, T.ArrayType):
            self.arrays[name] = Value(column, NUM if isinstance(kind.elementType, T.NumericType) else TEXT)
        else:
            self.values[name] = Value(column, NUM if isinstance(kind, T.NumericType) else TEXT)

    def field(self, name: str) -> Value | None:
        """A field, an element ``F(3)`` or ``F(I)`` of one that occurs, or None if it is unknown."""
        head = base_name(name)
        inner = str(name).partition("(")[2].rstrip(") ").strip()
        if inner and ":" not in inner and head in self.arrays:
            at = F.lit(int(inner)) if inner.lstrip("+-").isdigit() else (self.values[base_name(inner)].number().cast("int") if base_name(inner) in self.values else None)
            if at is not None:
                return Value(F.get(self.arrays[head].column, at - 1), self.arrays[head].kind)
        return self.values.get(head)


def expression(text: str, scope: Scope) -> Column:
    """Arithmetic as a column: unreadable fields count as 0, a quotient by 0 is 0, unknown fields are an ExpressionError."""

    def go(n: arithmetic.Node) -> Column:
        if n.op == "num":
            return number_literal(n.value)
        if n.op == "name":
            got = scope.field(n.name)
            if got is None:
                raise arithmetic.ExpressionError(f"unknown field {n.name}")
            x = got.number()
            return F.coalesce(x, F.lit(0).cast(_ZERO) if got.kind == TEXT else F.lit(0))
        if n.op == "neg":
            return -go(n.args[0])
        if n.op == "**":
            power = n.args[1]
            if power.op == "num" or (power.op == "neg" and power.args[0].op == "num"):
                k = int(power.value) if power.op == "num" else -int(power.args[0].value)
                once = go(n.args[0])
                product = reduce(lambda a, b: (a * b).cast("decimal(38,10)"), [once] * abs(k)) if k else F.lit(1)
                return product if k >= 0 else F.coalesce(F.try_divide(F.lit(1).cast(_ZERO), product), F.lit(0))
            return F.pow(go(n.args[0]), F.floor(go(power))).cast(_ZERO)
        a, b = map(go, n.args)
        if n.op == "/":
            return F.coalesce(F.try_divide(a, b), F.lit(0))
        return a + b if n.op == "+" else a - b if n.op == "-" else a * b

    return go(arithmetic.parse(text))


def operand(name: str, scope: Scope) -> Value:
    """A field or an arithmetic expression; unknown fields are missing."""
    got = scope.field(name)
    if got is None and arithmetic.LOOKS_LIKE.search(name):
        try:
            return Value(expression(name, scope), NUM)
        except arithmetic.ExpressionError:
            pass
    return got or Value(F.lit(None).cast("string"), TEXT)


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Value, b: Value, scope: Scope) -> Column:
    """A two-valued comparison."""
    of = _COMPARE[op]
    as_text = of(a.text(), b.text())
    if a.kind == b.kind == TEXT:
        out = as_text
    elif a.kind == b.kind == NUM:
        out = of(a.column, b.column)
    else:
        words = a if a.kind == TEXT else b
        if words.literal is not None:
            n = as_number(words.literal)
            x, y = (Value(number_literal(n), NUM) if v is words and n is not None else v for v in (a, b))
            out = of(x.column, y.column) if n is not None else as_text
        else:
            x, y = a.number(), b.number()
            out = F.when(x.isNotNull() & y.isNotNull(), of(x, y)).otherwise(as_text)
    if scope.missing == "none-text":
        none = [F.coalesce(v.text(), F.lit("None")) for v in (a, b)]
        out = F.when(a.column.isNull() | b.column.isNull(), of(*none)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def condition(c: Condition, scope: Scope) -> Column:
    """A condition as a boolean column that is never null."""
    if c.get("all") is not None:
        return reduce(lambda a, b: a & b, (condition(x, scope) for x in c["all"]), F.lit(True))
    if c.get("any") is not None:
        return reduce(lambda a, b: a | b, (condition(x, scope) for x in c["any"]), F.lit(False))
    if c.get("not") is not None:
        return ~condition(c["not"], scope)
    v, op = operand(c["source_name"], scope), c["op"]
    if op == "between":
        return compare(">=", v, literal(c["value"][0]), scope) & compare("<=", v, literal(c["value"][1]), scope)
    if op in ("in", "not_in"):
        kinds = [literal(x) for x in c["value"]]
        if kinds and all(k.kind == v.kind for k in kinds) and scope.missing == "false":
            side = v.text() if v.kind == TEXT else v.column
            members = [str(x).rstrip() if v.kind == TEXT else number_literal(Decimal(str(x))) for x in c["value"]]
            inside = F.coalesce(side.isin(members), F.lit(False))
            return inside if op == "in" else ~inside & v.column.isNotNull()
        if op == "in":
            return reduce(lambda a, b: a | b, (compare("==", v, k, scope) for k in kinds), F.lit(False))
        return reduce(lambda a, b: a & b, (compare("!=", v, k, scope) for k in kinds), F.lit(True))
    if op == "is_numeric":
        return v.column.isNotNull() if v.kind == NUM else F.coalesce(v.column.rlike("^[0-9]+$"), F.lit(False))
    if op == "is_alphabetic":
        return F.lit(False) if v.kind == NUM else F.coalesce(v.column.rlike(r"^[\p{L} ]*$"), F.lit(False))
    if op in ("is_positive", "is_negative", "is_zero"):
        n = F.coalesce(v.number(), F.lit(0))
        return {"is_positive": n > 0, "is_negative": n < 0, "is_zero": n == 0}[op]
    return compare(op, v, operand(c["ref"], scope) if c.get("ref") else literal(c.get("value")), scope)


def stored(a: Action, scope: Scope, entry: pic.Picture | None) -> Value:
    """The value that an action gives its target."""
    if a.type == "compute":
        try:
            v = Value(expression(a.expr, scope), NUM)
        except arithmetic.ExpressionError:
            return Value(F.lit(None).cast("string"), TEXT)
    elif a.expr:
        v = scope.field(a.expr) or Value(F.lit(None).cast("string"), TEXT)
    else:
        v = literal("" if a.value is None else a.value)
    if entry is None:
        return v if v.kind == NUM else Value(pic.store_text(v.column, None), TEXT)
    if entry.numeric:
        return Value(pic.store_number(v.number(), entry), NUM)
    return Value(pic.store_text(v.column, entry), TEXT)


def _meet(new: Value, old: Value | None, guard: Column) -> Value:
    """The new value where the guard holds, else the old one."""
    if old is None:
        return Value(F.when(guard, new.column), new.kind)
    if old.kind == new.kind:
        return Value(F.when(guard, new.column).otherwise(old.column), new.kind)
    return Value(F.when(guard, new.column.cast("string")).otherwise(old.column.cast("string")), TEXT)


def _reads(r: Rule) -> set[str]:
    from edictum.plans.ir import NAME, leaves

    out: set[str] = set()
    for x in (*leaves(r.conditions), *leaves(r.context)):
        for text in (x["source_name"], x.get("ref") or ""):
            out.update([base_name(text), *NAME.findall(text.upper())])
    for text in (*r.derivations.values(), *(a.expr or "" for a in (*r.actions, *r.else_actions)), *(a.source_name or "" for a in (*r.actions, *r.else_actions) if "(" in (a.source_name or ""))):
        out.update(NAME.findall(text.upper()))
    return out


def fold(df: DataFrame, rules: list[Rule], scope: Scope, pictures: Mapping[str, pic.Picture] | None = None, prefix: str = "__r") -> tuple[DataFrame, Scope, list[Column]]:
    """Run rules in order over every row: the frame with the state's columns, the final scope, and a guard for each rule.

    Rules that don't read what a rule before them wrote share a projection; a projection is begun
    only where one does, so the plan is as deep as the chain of dependent rules.
    """
    pictures = pictures or {}
    pending: dict[str, Value] = {}
    guards: list[Column] = []
    guard_names: list[str] = []
    waiting: list[tuple[str, Column]] = []
    count = 0

    def settle() -> None:
        nonlocal df, count
        if not waiting and not pending:
            return
        cols = dict(waiting)
        for name, v in pending.items():
            column = f"{prefix}_{count}_{name}"
            cols[column] = v.column
            scope.values[name] = Value(F.col(f"`{column}`"), v.kind)
        df = df.withColumns(cols)
        count += 1
        pending.clear()
        waiting.clear()

    for k, r in enumerate(rules):
        if _reads(r) & set(pending) or len(waiting) >= 64:
            settle()
        local = Scope(dict(scope.values), scope.missing, scope.arrays)
        for name, expr in r.derivations.items():
            try:
                local.values[base_name(name)] = Value(expression(expr, local), NUM)
                pending[base_name(name)] = local.values[base_name(name)]
            except arithmetic.ExpressionError:
                pass
        reach = None if r.context is None else condition(r.context, local)
        fires = condition(r.conditions, local)
        hit = fires if reach is None else reach & fires
        miss = ~fires if reach is None else reach & ~fires
        guard = f"{prefix}_g{k}"
        waiting.append((guard, hit))
        guard_names.append(guard)
        for actions, when in ((r.actions, hit), (r.else_actions, miss)):
            seen = Scope(dict(local.values), local.missing, local.arrays)
            for a in actions:
                if a.writes:
                    name = base_name(a.source_name or a.target or "")
                    new = stored(a, seen, pictures.get(name))
                    seen.values[name] = new
                    pending[name] = _meet(new, pending.get(name) or local.values.get(name), when)
    settle()
    guards = [F.col(f"`{g}`") for g in guard_names]
    return df, scope, guards


def score(df: DataFrame, rules: list[Rule], bindings: Mapping[str, str | Column] | None = None, defaults: Mapping[str, Any] | None = None, pictures: Mapping[str, pic.Picture] | None = None, missing: str = "false") -> DataFrame:
    """``df`` with a column for each output of the rules (by business name) and ``fired_rules``, ids in rule order.

    ``bindings``: field to column. ``defaults``: values of fields where there is none. With
    ``pictures`` a write keeps what the target's picture keeps; without, values stay whole.
    A column of ``df`` named as an output is replaced.
    """
    scope = Scope.of(df, bindings, missing)
    for name, v in (defaults or {}).items():
        new, key = literal(v), base_name(name)
        old = scope.values.get(key)
        scope.values[key] = new if old is None else Value(F.coalesce(old.column, new.column if new.kind == old.kind else new.column.cast("string")), old.kind)
    columns = df.columns
    out, scope, guards = fold(df, rules, scope, pictures)
    fired = F.array_compact(F.array(*(F.when(g, F.lit(r.rule_id)) for g, r in zip(guards, rules)))) if rules else F.array().cast("array<string>")
    decided = {business: scope.values[name].column.alias(business) for business, name in outputs(rules).items() if name in scope.values}
    kept = [F.col(f"`{c}`") for c in columns if c not in decided and c != "fired_rules"]
    return out.select(*kept, *decided.values(), fired.alias("fired_rules"))
