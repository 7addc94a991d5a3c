"""Token buckets by key over a table of requests, and over a stream of them (an extension)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from edictum.shipping import ship_package

#: Requests a minute by class.
RATES = {"read": 1200, "write": 120, "score": 6000}
DECISIONS = "key string, kind string, at double, allowed boolean, wait double"


def take(level: float, last: float, now: float, per_minute: int) -> tuple[float, float | None]:
    """(level after, None) if a token is there; else (level, seconds until there is one)."""
    level = min(float(per_minute), level + max(0.0, now - last) * per_minute / 60)
    return (level - 1, None) if level >= 1 else (level, (1 - level) * 60 / per_minute)


def _walk(rows: pd.DataFrame, level: float, last: float, rate: int) -> tuple[pd.DataFrame, float, float]:
    out = []
    for r in rows.sort_values("at", kind="stable").itertuples(index=False):
        level, wait = take(level, last, r.at, rate)
        last = max(last, r.at)
        out.append((r.key, r.kind, r.at, wait is None, wait))
    return pd.DataFrame(out, columns=["key", "kind", "at", "allowed", "wait"]), level, last


def limit_requests(requests: DataFrame, rates: dict[str, int] | None = None) -> DataFrame:
    """Which requests (key, kind, at in seconds) are allowed, each key and kind from a full bucket, in order of time."""
    known = rates or RATES

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rate = known[rows["kind"].iloc[0]]
        return _walk(rows, float(rate), float(rows["at"].min()), rate)[0]

    ship_package(requests.sparkSession)
    return requests.groupBy("key", "kind").applyInPandas(run, DECISIONS)


def limit_stream(requests: DataFrame, rates: dict[str, int] | None = None) -> DataFrame:
    """The same over a stream; each key's level and time are its state. Requests of a batch are taken in order of time."""
    known = rates or RATES

    def run(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rate = known[key[1]]
        level, last = state.get if state.exists else (float(rate), float(rows["at"].min()))
        out, level, last = _walk(rows, level, last, rate)
        state.update((level, last))
        yield out

    ship_package(requests.sparkSession)
    return requests.groupBy("key", "kind").applyInPandasWithState(run, DECISIONS, "level double, last double", "append", "NoTimeout")
