"""Measures over scored rows: agreement, calibration, ranking quality, latency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.operators.ordered import running_sum
from edictum.shipping import ship_package
from edictum.workspace import materialize

#: Upper bounds of latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, for all rows or by group."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*by).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration_error(df: DataFrame, p: Column, correct: Column, bins: int = 10) -> DataFrame:
    """``ece`` and ``brier`` of probabilities against outcomes."""
    y = correct.cast("double")
    binned = df.select(p.cast("double").alias("p"), y.alias("y")).filter("p is not null and y is not null")
    per = binned.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def auroc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """``auroc``: the chance that a positive row scores above a negative one, ties counting half.

    Counts by score are summed below each score, range by range.
    """
    per = df.select(score.alias("s"), positive.cast("boolean").alias("y")).filter("s is not null and y is not null").groupBy("s").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum((~F.col("y")).cast("long")).alias("n"))
    won = running_sum(per, "s", "n", "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(F.try_divide(F.col("w").cast("double"), (F.col("p") * F.col("n")).cast("double")).alias("auroc"))


#: Stacks of blocks that are put together at a time.
MERGED = 8
_BLOCKS = "at long, s double, w double, first double, last double"


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order (sum, weight, first and last x), with neighbours that don't rise put together."""
    out: list[tuple[float, float, float, float]] = []
    for s, w, first, last in blocks.sort_values("first")[["s", "w", "first", "last"]].itertuples(index=False):
        while out and out[-1][0] * w >= s * out[-1][1]:
            s, w, first = s + out[-1][0], w + out[-1][1], out.pop()[2]
        out.append((s, w, first, last))
    return pd.DataFrame(out, columns=["s", "w", "first", "last"])


def isotonic_knots(df: DataFrame, score: Column, correct: Column) -> DataFrame:
    """Knots (x, y) of the non-decreasing fit of outcomes to scores, by pooling adjacent violators.

    Rows are summed by score and dealt out by ranges of it. Each range pools its own blocks; then stacks of blocks of
    neighbouring ranges are put together, MERGED at a time, which pools across their bounds, until one is left: that of the fit.
    Scores and outcomes that are null take no part.
    """
    per = df.groupBy(score.cast("double").alias("first")).agg(F.sum(correct.cast("double")).alias("s"), F.count(correct).cast("double").alias("w")).filter("first is not null and w > 0")
    ship_package(df.sparkSession)
    ranges = materialize(per.repartitionByRange("first").withColumn("at", F.spark_partition_id().cast("long")).withColumn("last", F.col("first")), "ranges")
    most = ranges.agg(F.max("at")).first()[0] or 0

    def pool(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pooled(rows).assign(at=key[0])[["at", "s", "w", "first", "last"]]

    blocks = ranges.groupBy("at").applyInPandas(pool, _BLOCKS)
    while most:
        blocks, most = blocks.groupBy(F.floor(F.col("at") / MERGED).alias("at")).applyInPandas(pool, _BLOCKS), most // MERGED
    ends = F.when(F.col("first") < F.col("last"), F.array("first", "last")).otherwise(F.array("first"))
    return blocks.select(F.explode(ends).alias("x"), (F.col("s") / F.col("w")).alias("y"))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """The piecewise linear value at x, that of the nearest knot outside; null without knots."""
    if not knots:
        return F.lit(None).cast("double")
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, F.round(y0 + (y1 - y0) * (x - x0) / (x1 - x0), 4) if x1 > x0 else F.lit(y1))
    return out.otherwise(F.lit(knots[-1][1]))


def histogram(df: DataFrame, value: Column, buckets: tuple[float, ...] = BUCKETS, *by: str) -> DataFrame:
    """Cumulative counts: ``le`` (the bound as text, +Inf last) and ``n``, with sum and count of all values."""
    counts = df.groupBy(*by).agg(*(F.sum(F.when(value <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(buckets)), F.count(value).alias("total"), F.sum(value).alias("sum"))
    rows = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)), F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counts.select(*by, F.explode(rows).alias("r"), "sum").select(*by, "r.le", F.col("r.n").cast("long").alias("n"), "sum")


def exposition(rows: DataFrame, name: str) -> Iterator[str]:
    """Histogram rows as text for a metrics scraper."""
    got = rows.collect()
    yield f"# TYPE {name} histogram"
    yield from (f'{name}_bucket{{le="{r["le"]}"}} {r["n"]}' for r in got)
    if got:
        yield f"{name}_sum {got[0]['sum']}"
        yield f"{name}_count {max(r['n'] for r in got)}"


def percentile_by_index(df: DataFrame, value: Column, share: float = 0.95) -> DataFrame:
    """``value`` at the index int(share x n) - 1 of the sorted values (the first, at least)."""
    rows = df.select(value.alias("value")).filter("value is not null")
    counted = rows.groupBy("value").count()
    total = counted.agg(F.sum("count").alias("all"))
    upto = running_sum(counted, "value", "count", "before").crossJoin(F.broadcast(total))
    return upto.filter(F.col("before") + F.col("count") >= F.greatest(F.floor(F.col("all") * share), F.lit(1))).agg(F.min("value").alias("value"))


def token_set(text: Column) -> Column:
    """Different words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two sets; two empty sets agree, one empty set doesn't."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(ratio(2 * common, F.size(a) + F.size(b)))


def mean_pairwise(values: list[set[str]]) -> float:
    """Mean Jaccard of all pairs of a few sets."""
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    return float(np.mean([len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs])) if pairs else 1.0
