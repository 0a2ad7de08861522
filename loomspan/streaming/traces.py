"""Continuous generation: each tick of a rate source is a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans.shape import Span, shape_events
from loomspan.sources.inputs import traces


def streamed_events(spark: SparkSession, shape: Span, seed: int, rows_per_second: int = 10) -> DataFrame:
    """Streaming events of one trace per tick; stateless, so it appends and restarts cleanly."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return shape_events(traces(ticks, "value"), shape, seed)
