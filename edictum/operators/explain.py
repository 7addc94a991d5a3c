"""Why a rule set decides as it does: exact Shapley values of its inputs.

For every row each subset of the inputs (a coalition) takes its values from the row and the other inputs from a
baseline; the rule set is scored on all of them, as rows of one table. An input's value is the weighted mean of what it adds
to the coalitions without it. The values of a row sum to the difference between its score and the baseline's.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.plans.compile import score
from edictum.plans.ir import Rule

#: Inputs at most: a row is scored on 2 to so many coalitions.
INPUTS = 12


def _weights(m: int) -> list[float]:
    """The weight of a coalition by its size, for an input that isn't in it."""
    return [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]


def shapley(df: DataFrame, key: str, rules: list[Rule], output: str, baseline: Mapping[str, Any], bindings: Mapping[str, str], value: str | None = None, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """``key``, ``field``, ``effect``, ``score``, ``base``: a row for each row of ``df`` and field of ``baseline``.

    ``bindings`` names the column of each field; fields without a baseline keep their values. The score is the output as a number (null counts as 0), or, with
    ``value``, 1 where the output is that text, else 0. ``key`` names each row of ``df`` once. Missing values are values: a rule may test them.
    """
    fields = sorted(baseline)
    m = len(fields)
    if not 0 < m <= INPUTS:
        raise ValueError(f"1 to {INPUTS} inputs, not {m}")
    inside = lambda i: F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0
    kinds = {f: df.schema[bindings[f]].dataType for f in fields}
    taken = [F.when(inside(i), F.col(f"`{bindings[f]}`")).otherwise(F.lit(baseline[f]).cast(kinds[f])).alias(f"__f{i}") for i, f in enumerate(fields)]
    kept = [f for f in bindings if f not in baseline]
    rows = df.select(F.col(f"`{key}`").alias("__key"), *(F.col(f"`{bindings[f]}`").alias(f"__k{i}") for i, f in enumerate(kept)), *(F.col(f"`{bindings[f]}`") for f in fields))
    rows = rows.withColumn("__mask", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    rows = rows.select("__key", "__mask", *(f"__k{i}" for i in range(len(kept))), *taken)
    scored = score(rows, rules, {f: f"__f{i}" for i, f in enumerate(fields)} | {f: f"__k{i}" for i, f in enumerate(kept)}, defaults)
    out = F.col(f"`{output}`")
    got: Column = F.coalesce(out.try_cast("double"), F.lit(0.0)) if value is None else F.coalesce(F.rtrim(out.cast("string")) == value, F.lit(False)).cast("double")
    weights = F.array(*map(F.lit, _weights(m)))
    size = F.bit_count("__mask")
    adds = lambda i: F.when(inside(i), F.get(weights, size - 1)).otherwise(-F.get(weights, size)) * F.col("__got")
    sums = [F.sum(adds(i)).alias(f"e{i}") for i in range(m)]
    full, none = (F.max(F.when(F.col("__mask") == mask, F.col("__got"))) for mask in ((1 << m) - 1, 0))
    each = scored.withColumn("__got", got).groupBy("__key").agg(*sums, full.alias("score"), none.alias("base"))
    effects = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"e{i}").alias("effect")) for i, f in enumerate(fields)))
    return each.select(F.col("__key").alias(key), F.explode(effects).alias("e"), "score", "base").select(key, "e.field", "e.effect", "score", "base")


def importance(effects: DataFrame) -> DataFrame:
    """``field`` and ``share``: the mean size of its effects, as a share of all; 0 if nothing has any."""
    per = effects.groupBy("field").agg(F.avg(F.abs("effect")).alias("mean"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("mean").alias("all")))).select("field", F.coalesce(F.try_divide("mean", "all"), F.lit(0.0)).alias("share"))
