"""Line dedup by a log-template tree of fixed depth.

Tokens that hold a digit are read as ``<*>``. A line's leaf in the tree is the number of its
tokens and the first DEPTH of them. A leaf holds any number of templates: each of its lines as
it is, and each of its lines with one run of tokens after the leading ones left open, of a fifth
of the line's tokens (in lines of at least FIFTH tokens), so that the lines of a template agree
in at least four fifths of their places. A template that stands in several documents recurs, and
is dropped wherever it stands but in its first place, the least by document and line. Lines and
templates without a token that is no ``<*>`` say nothing: they are left alone, as blank lines
are. Short lines have only themselves as a template.

Lines travel as hashes, templates are keys: what recurs is found by aggregates that combine
before the shuffle, and no task holds a leaf. Keys that hold very many lines are met by
broadcasting them, and there can be only few of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.workspace import OWN, apart, join_unevenly, materialize, materialize_counted

DEPTH = 4
FIFTH = 5
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with single spaces, and ``<*>`` for each token that holds a digit."""
    spaced = F.when(line.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.btrim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "), F.lit(" "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(spaced)


def _place(tokens: Column) -> Column:
    """Of a line's tokens: its leaf, a hash of the line, hashes of its open templates, and whether it says anything."""
    n, leading = F.size(tokens), F.slice(tokens, 1, DEPTH)
    says = lambda of: F.exists(of, lambda t: (t != FIELD) & (t != ""))
    run = F.floor(n / FIFTH).cast("int")
    runs = F.sequence(F.lit(0), F.ceil((n - DEPTH) / run).cast("int") - 1)
    without = lambda j: F.xxhash64(j, F.slice(tokens, DEPTH + 1, j * run), F.slice(tokens, DEPTH + 1 + (j + 1) * run, n))
    templates = F.when((n >= FIFTH) & says(leading), F.transform(runs, without))
    return F.struct(F.xxhash64(n, leading).alias("leaf"), F.xxhash64(tokens).alias("h"), templates.alias("open"), says(tokens).alias("says"))


def _lines(docs: DataFrame) -> DataFrame:
    """Each line that says anything: document, number and hashes. The text itself is not exploded."""
    each = F.transform(F.transform(F.split("text", "\n"), lambda x: F.split(masked(x), " ")), _place)
    return docs.select("doc", "th", F.posexplode(each).alias("line_no", "l")).filter("l.says").select("doc", "th", "line_no", "l.leaf", "l.h", "l.open")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc``, ``th``, ``gone`` (numbers of lines to drop) for the documents that lose lines.

    ``docs`` has doc (an id), th (a hash of the text) and text.
    """
    lines, n_lines = materialize_counted(_lines(docs), "lines")
    place = F.struct("doc", "line_no", "th")
    # each different line: its first place, the last document that has it, and how often it stands
    by_line = lines.groupBy("leaf", "h").agg(F.min(place).alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("rows"), F.first("open").alias("open"))
    by_line, n_different = materialize_counted(by_line, "by_line")
    # leaves with different lines, from several documents: only their lines can have open templates that recur
    leaves = by_line.filter("open is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("first.doc").alias("a"), F.max("last").alias("b")).filter("n > 1 and a <> b").select("leaf", "n")
    some = join_unevenly(by_line.filter("open is not null").select("leaf", "h", "first", "last", "open"), leaves, ["leaf"], "n", n_different)
    opened, n_open = materialize_counted(some.select("leaf", "h", "first", "last", F.explode("open").alias("template")), "open")
    templates = opened.groupBy("leaf", "template").agg(F.min("first").alias("keep"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keep.doc <> last").select("leaf", "template", "keep", "n")
    varied = join_unevenly(opened.select("leaf", "h", "template"), materialize(templates, "templates"), ["leaf", "template"], "n", n_open)
    # the one place that each line of a recurring template leaves alone: the first of all its templates
    varied = varied.groupBy("leaf", "h").agg(F.min("keep").alias("other"))
    keep = F.when(F.col("first.doc") != F.col("last"), F.least("first", F.coalesce("other", "first"))).otherwise(F.col("other"))
    recurring = by_line.select("leaf", "h", "first", "last", "rows").join(varied, ["leaf", "h"], "left").select("leaf", "h", "rows", keep.alias("keep")).filter("keep is not null")
    # a line that stands once, in the place to keep, loses nothing
    recurring = materialize(recurring, "recurring")
    gone = join_unevenly(lines.select("doc", "th", "line_no", "leaf", "h"), recurring, ["leaf", "h"], "rows", n_lines).filter(place != F.col("keep"))
    return gone.groupBy("doc", "th").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text without its repeated lines, and ``n_lines``, ``n_dropped``.

    Documents are told apart by id and text: rows repeated in both are one document and keep the
    same lines. A template that recurs only inside one doc_id isn't dropped. Null texts stay null,
    with no lines; documents that lose all lines have an empty text. Rows without an id take no
    part and stay as they are. An empty table gives no rows. Columns named n_lines or n_dropped
    are replaced. A document of very many lines takes time in proportion to them.
    """
    text = F.col(f"{OWN}.`{text_col}`")
    keyed = apart(docs).withColumn("__doc", F.col(f"{OWN}.`{id_col}`").cast("long")).withColumn("__th", F.xxhash64(text))
    gone = dropped_lines(keyed.filter(F.col("__doc").isNotNull() & text.isNotNull()).select(F.col("__doc").alias("doc"), F.col("__th").alias("th"), text.alias("text")))
    gone = gone.select(F.col("doc").alias("__d"), F.col("th").alias("__t"), F.col("gone").alias("__gone"))
    out = keyed.hint("merge").join(gone.hint("merge"), (F.col("__doc") == F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    lines = F.split(text, "\n")
    # places by a hash set, not line by line against all that go
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    out = out.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    kept = F.transform(left, lambda i: F.get(F.col("__lines"), i))
    counts = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))}
    new = counts | {text_col: F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(text)}
    names = [*docs.columns, *(c for c in counts if c not in docs.columns)]
    return out.select(*(new[c].alias(c) if c in new else F.col(f"{OWN}.`{c}`") for c in names))
