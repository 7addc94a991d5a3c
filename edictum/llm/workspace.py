"""The shared workspace, and the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.workspace import broadcast_if_small, discard, fresh_path, materialize, materialize_counted, shared_dir

__all__ = ["OWN", "apart", "broadcast_if_small", "discard", "fresh_path", "join_unevenly", "materialize", "materialize_counted", "shared_dir", "HEAVY", "table"]

#: A key is heavy if it has over 1/HEAVY of an even partition's rows, so there are fewer than HEAVY heavy keys a partition.
HEAVY = 8


OWN = "own"


def apart(df: DataFrame) -> DataFrame:
    """``df`` as one column OWN, a struct of all its columns, so that columns put beside it can have any name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(OWN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_unevenly(rows: DataFrame, verdicts: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``verdicts`` on keys of any skew; ``weight`` is not kept.

    ``verdicts`` has each key once, with its number of rows as ``weight``; ``total`` is the number
    of all rows. Rows of heavy keys stay where they are: their verdicts, of which there are fewer
    than HEAVY a shuffle partition, are broadcast. The others are shuffled.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.col(weight) > total // (HEAVY * parts)
    few, many = F.broadcast(verdicts.filter(heavy).drop(weight)), verdicts.filter(~heavy).drop(weight)
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(many, on))
