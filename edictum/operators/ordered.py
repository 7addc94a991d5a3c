"""Running sums and previous rows over a whole table, without one task that holds it.

Rows are dealt out by ranges of the order; what a range needs of those before it is a row a
range, and inside a range a window does the rest. The dealt rows are written once, so both sides
see the same ranges, and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edictum.workspace import materialize


def _ranges(df: DataFrame, order: str) -> DataFrame:
    return materialize(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each; 0 for the first. Equal order values come in any order."""
    rows = _ranges(df, order)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = rows.groupBy("__range").agg(F.sum(value).alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals, "__range").withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__range", "__before")


def previous(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``value`` of the row before each; null for the first."""
    rows = _ranges(df, order)
    last = rows.groupBy("__range").agg(F.max_by(value, order).alias("__last"))
    carried = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__carried"))
    inside = Window.partitionBy("__range").orderBy(order)
    first = F.row_number().over(inside) == 1
    return rows.join(carried, "__range").withColumn(name, F.when(first, F.col("__carried")).otherwise(F.lag(value).over(inside))).drop("__range", "__carried")
