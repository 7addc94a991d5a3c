"""The syntax tree of a legacy program, and its data dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from edictum.functions.pic import Picture, parse_picture
from edictum.plans.ir import Condition


@dataclass(eq=False)
class Item:
    """A data item. ``values`` of a condition name (level 88) are its alternatives: (value,) or (from, to)."""

    level: int
    name: str
    section: str
    file: str
    line: int
    pic: str | None = None
    usage: str | None = None
    value: Any = None
    values: list[tuple] = field(default_factory=list)
    redefines: str | None = None
    occurs: int = 1
    comment: str | None = None
    parent: Item | None = None
    children: list[Item] = field(default_factory=list)

    @property
    def picture(self) -> Picture | None:
        """The picture; numeric usages without one have 9 digits; groups have none."""
        if self.pic:
            return parse_picture(self.pic)
        return Picture("numeric", 9, 0, True, 9) if self.usage and not self.children else None

    def entry(self) -> dict[str, Any]:
        """As a flat document."""
        p = self.picture
        out = {"level": self.level, "pic": self.pic, "usage": self.usage, "category": p.category if p else "group", "int_digits": p.int_digits if p else None, "scale": p.scale if p else None, "signed": p.signed if p else None, "length": p.length if p else None}
        out |= {"value": None if self.value is None else str(self.value), "values88": [[str(v) for v in x] for x in self.values] or None, "redefines": self.redefines, "occurs": self.occurs, "parent": self.parent.name if self.parent else None, "comment": self.comment, "defined_in": f"{self.file}:{self.line}"}
        return {k: v for k, v in out.items() if v is not None}


class Dictionary:
    """Data items in source order."""

    def __init__(self) -> None:
        self.items: list[Item] = []
        self.by_name: dict[str, list[Item]] = {}

    def add(self, item: Item) -> None:
        """Append an item."""
        self.items.append(item)
        self.by_name.setdefault(item.name, []).append(item)

    def find(self, name: str, of: str | None = None) -> Item | None:
        """The first item of a name, or of those the first below a group."""
        for x in self.by_name.get(name.partition("(")[0].strip().upper(), []):
            up = x.parent
            while of and up and up.name != of:
                up = up.parent
            if not of or up:
                return x
        return None


@dataclass(frozen=True)
class Operand:
    """A literal (``value``) or text: a field or arithmetic."""

    text: str
    value: Any = None
    literal: bool = False
    simple: bool = True


@dataclass(eq=False)
class Statement:
    """``verb`` tells which of the other attributes count; parts are (label, condition, line, statements)."""

    verb: str
    file: str
    line: int
    end: int = 0
    text: str = ""
    condition: Condition | None = None
    notes: tuple[str, ...] = ()
    parts: list[Part] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    source: Operand | None = None
    assigns: list[tuple[str, str]] = field(default_factory=list)
    thru: str | None = None
    loop: dict[str, Any] | None = None
    table: str | None = None
    all_rows: bool = False


@dataclass(eq=False)
class Part:
    """A branch: then, else, when, other, at_end, body or handler."""

    label: str
    condition: Condition | None
    line: int
    statements: list[Statement]
    notes: tuple[str, ...] = ()


@dataclass(eq=False)
class Paragraph:
    """A paragraph; the entry of a section or division has no name."""

    name: str
    section: str | None
    file: str
    line: int
    statements: list[Statement] = field(default_factory=list)


@dataclass
class Program:
    """A parsed program."""

    program_id: str = "UNNAMED"
    dictionary: Dictionary = field(default_factory=Dictionary)
    paragraphs: list[Paragraph] = field(default_factory=list)
    using: list[str] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def statements(self) -> Iterator[Statement]:
        """All statements, outer ones first."""
        todo = [s for p in reversed(self.paragraphs) for s in reversed(p.statements)]
        while todo:
            s = todo.pop()
            yield s
            todo.extend(x for p in reversed(s.parts) for x in reversed(p.statements))


def number(text: str) -> int | float:
    """A numeric literal."""
    d = Decimal(text)
    return int(d) if d == d.to_integral_value() and "." not in text else float(d)
