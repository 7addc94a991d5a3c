"""Scoring a stream (an extension): the compiled columns have no state, so a stream is scored like a table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from edictum.plans.compile import score
from edictum.plans.ir import Rule


def score_stream(stream: DataFrame, rules: list[Rule], path: str, checkpoint: str, bindings: Mapping[str, str | Column] | None = None, defaults: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Score a stream's rows and append them to a Parquet table, once each; runs until all there is has been read."""
    return score(stream, rules, bindings, defaults).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
