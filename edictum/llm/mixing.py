"""Mixing sources to target weights by capped water-filling.

A source's target is its share by weight of the words to draw, but at most ``max_epochs`` times
its size; what is clamped away goes to the other sources by weight until none is above. The
fixed point is found at once: with sources in order of size over weight, a prefix of them is
clamped, and the rest share what the prefix leaves. Each document is taken as many whole times
as the epochs of its source, and the fraction left is a seeded sample: documents in the order
of a hash of their id, then one of their text, then any, up to the one whose middle passes the
fraction. That order is cut at a key, found by sums over ever longer prefixes of the keys, so
neither a source nor an id or a repeated row has to fit in a task; all else about a document is
local to its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictum.llm.workspace import OWN, apart, broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast, with their targets.
FEW_SOURCES = 5_000
#: Digits of a key up to the ends of: a bucket of ids, the id, a bucket of its texts, the text, the partition, the row.
GROUP = 48
LEVELS = (3, 32, 35, GROUP, 56, 65)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The seeded place of a document in its source, the same for rows that are equal in id and text."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def row_digits() -> Column:
    """Digits that tell rows of a table apart, once it is written: those of the partition, then those of the row."""
    row = F.monotonically_increasing_id()
    return F.concat(F.lpad(F.hex(F.shiftright(row, 33)), 8, "0"), F.lpad(F.hex(row.bitwiseAND((1 << 33) - 1)), 9, "0"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` for a table with one row (source, source_size) for each source.

    Sources in code-point order, null last, weigh ``weights``, repeating. The table has a row a
    source, so its windows hold names, not documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the level that holds is that of the first source that isn't clamped; if all are, none is needed
    free = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source"))
    return w.withColumn("flat", F.min_by("level", free).over(everything)).select("source", "source_size", F.coalesce(F.least("cap", F.col("flat") * F.col("w")), F.col("cap")).alias("target"))


def _cuts(sized: DataFrame, goals: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``source`` and ``cut``: documents with a key up to it are taken once more; null if none is."""
    last = goals.select(F.col("source").alias("s"), "extra", F.lit("").alias("floor"), F.lit(0).cast("long").alias("before"))
    upto = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.select("source", "size", "key").filter("size > 0")
    for digits in levels:
        inside = rows.join(F.broadcast(last) if goals._edictum_few else last, F.col("source").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("floor")))
        parts = inside.groupBy("s", "extra", "floor", "before", F.substring("key", 1, digits).alias("part")).agg(F.sum("size").alias("n"))
        placed = parts.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        if digits == levels[-1]:
            break
        # the middle of the last document taken is below ``extra``: it lies in the last part that begins below it
        found = placed.filter("from < extra").groupBy("s", "extra").agg(F.max_by(F.struct(F.col("part").alias("floor"), F.col("from").alias("before")), "part").alias("p"))
        last = materialize(found.select("s", "extra", "p.floor", "p.before"), "cut")
    taken = placed.filter("from + n / 2 < extra").groupBy(F.col("s").alias("t")).agg(F.max("part").alias("cut"))
    # if even the part's first document is too much, all before the part are taken
    return last.join(taken, F.col("s").eqNullSafe(F.col("t")), "left").select(F.col("s").alias("source"), F.coalesce("cut", "floor").alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, plan): ``sized`` has doc_id, source, size, key of every row; ``plan`` has source, source_size, target, whole, cut.

    A row of a source is taken ``whole`` times, and once more if its key is at most ``cut``. Null
    sources are one source, last in order. Null and empty texts have size 0 and are taken no words
    of. Repeated rows are documents of their own, next to each other in the order; so are rows that
    share a doc_id, or have none, by their texts. The cut can fall between any two rows. An empty
    table gives an empty plan.
    """
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.concat(order_key(F.col(id_col), F.col(text_col), seed), row_digits()).alias("key")), "sized")
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("int")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    goals._edictum_few = goals.count() <= FEW_SOURCES
    cuts = _cuts(sized, goals).select(F.col("source").alias("s"), "cut")
    plan = materialize(goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut"), "plan")
    return sized, plan


def times(key: Column) -> Column:
    """How often a document is taken, by the columns of its source's plan."""
    return F.col("whole") + F.when(key <= F.col("cut"), 1).otherwise(0)


def with_plan(rows: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    """Rows with the plan of their source; the plan is broadcast only if it has few sources."""
    named = plan.withColumnRenamed("source", "__source")
    return rows.join(broadcast_if_small(named, FEW_SOURCES), source.eqNullSafe(F.col("__source"))).drop("__source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Rows without words, of null or empty texts too, have nothing to take and go. Very long texts are rows like others. An empty table gives no rows.
    """
    sized, plan = mix(docs, **options)
    id_col, text, source = (F.col(f"{OWN}.`{options.get(f'{c}_col', n)}`") for c, n in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    source = source.cast("string")
    # of the rows that are equal in id and text and hold the cut: all, and those taken once more
    at_cut = with_plan(sized.filter("size > 0").withColumnRenamed("source", "__of"), plan.select("source", "cut"), F.col("__of")).filter(F.substring("key", 1, GROUP) == F.substring("cut", 1, GROUP))
    at_cut = at_cut.groupBy(F.col("__of").alias("of")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("key") <= F.col("cut")).alias("some"))
    plan = plan.join(at_cut, F.col("source").eqNullSafe(F.col("of")), "left")
    plan = materialize(plan.select("source", F.col("whole").alias("__whole"), F.substring("cut", 1, GROUP).alias("__cut"), F.coalesce(F.col("all"), F.lit(0)).alias("__all"), F.coalesce(F.col("some"), F.lit(0)).alias("__some")), "plan")
    keyed = apart(docs).withColumn("__key", order_key(id_col, text, options.get("seed", 17))).filter(F.coalesce(text.rlike(WORD), F.lit(False)))
    out = with_plan(keyed, plan, source)
    parted = plan.filter("0 < __some and __some < __all")
    more = F.col("__key") < F.col("__cut")
    if parted.isEmpty():
        out = out.withColumn("__more", more | (F.col("__key") == F.col("__cut")) & (F.col("__some") > 0))
    else:
        split = (F.col("__key") == F.coalesce("__cut", F.lit(""))) & (F.col("__some") > 0) & (F.col("__some") < F.col("__all"))
        equal = materialize(out.filter(split).withColumn("__of", source).withColumn("__row", row_digits()), "equal")
        goals = parted.select("source", F.col("__some").alias("extra"))
        goals._edictum_few = goals.count() <= FEW_SOURCES
        cuts = _cuts(equal.select(F.col("__of").alias("source"), F.lit(1).alias("size"), F.col("__row").alias("key")), goals, (8, 17)).withColumnRenamed("cut", "__last")
        equal = with_plan(equal, cuts, F.col("__of")).withColumn("__more", F.col("__row") <= F.col("__last"))
        out = out.filter(~split).withColumn("__more", more | (F.col("__key") == F.col("__cut")) & (F.col("__some") > 0))
        out = out.unionByName(equal.select(*out.columns))
    n = F.col("__whole") + F.when(F.col("__more"), 1).otherwise(0)
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(f"{OWN}.*")
