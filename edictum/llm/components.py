"""Connected components by alternating large-star and small-star steps, with DataFrame operations only.

Every step is a min-aggregate (combined before the shuffle) joined back to the edges: one row a
node on one side, so a hub with very many edges is a skewed join that adaptive execution can
split, and never one group gathered in a task. The number of rounds is logarithmic in the
length of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.workspace import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's larger (or smaller) neighbours to the least node around it."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node of an edge that joins two nodes.

    Edges are undirected; nulls, loops and repeated edges have no effect; no edges give no rows.
    Raises RuntimeError if ``max_rounds`` rounds don't settle it, rather than return wrong classes.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new = materialize(_star(_star(now, large=True).distinct(), large=False).distinct(), "edges")
        discard(now)
        now, before = new, seen
        if (seen := _digest(now)) == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
