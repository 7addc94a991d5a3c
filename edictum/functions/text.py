"""Names and words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a rule.
EMPTY_WORDS = frozenset("the a an of for and or to in on with is are when than at least more less that by be as any all other their its".split())
_NUMBER = r"(\d[\d,]*(?:\.\d+)?)"


def content_words(text: str) -> set[str]:
    """Words of a text that say something."""
    return set(re.findall(r"[a-z0-9.%]+", text.lower())) - EMPTY_WORDS


def content_words_column(text: Column) -> Column:
    """The same as a column."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9.%]+)"), F.lit(1))), F.array(*(F.lit(w) for w in sorted(EMPTY_WORDS))))


def snake(text: Column) -> Column:
    """snake_case of a name."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def base(name: Column) -> Column:
    """A field name without subscript, in upper case."""
    return F.upper(F.btrim(F.substring_index(name, "(", 1)))


def canonical_expression(text: Column) -> Column:
    """Upper case, no white space, no unary plus."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), r"\s+", ""), r"(^|[-+*/(=])\+", "$1")


def numbers(text: Column) -> Column:
    """Numbers in a text, thousands separators removed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(",")).try_cast("double")), lambda x: x.isNotNull())


def grounded(intent: Column, allowed: Column) -> Column:
    """Whether each number of the intent, or it times or over 100, is among the allowed ones."""
    return F.forall(numbers(intent), lambda n: F.exists(allowed, lambda a: (F.abs(a - n) < 1e-9) | (F.abs(a * 100 - n) < 1e-9) | (F.abs(a - n * 100) < 1e-9)))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of the one stand in the other in order."""
    letters = F.filter(F.split(short, ""), lambda c: c != "")
    found = F.aggregate(letters, F.lit(1), lambda at, c: F.nullif(F.position(c, long, at), F.lit(0)) + 1)
    return found.isNotNull()


def abbreviates(token: str, words: set[str]) -> bool:
    """Whether a token is one of the words, a beginning of one, or its letters in order."""

    def in_order(short: str, long: str) -> bool:
        rest = iter(long)
        return all(c in rest for c in short)

    return any(token == w or (len(token) >= 3 and w.startswith(token)) or (len(token) >= 3 and len(w) >= 3 and token.startswith(w)) or (len(token) >= 2 and token[0] == w[0] and in_order(token, w)) for w in words if w)
