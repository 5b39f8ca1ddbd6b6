"""Scoring arriving cells with fitted models, and running group statistics.

All scorers are row-local given broadcast state, so the same functions serve
batch and stream; the aggregate keeps one row of state per key and window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch scorer to each micro-batch and append parquet; a batch written twice is overwritten, not doubled."""

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_group_stats(stream: DataFrame, time: str, late: str, window: str, keys: list[str], value: str) -> DataFrame:
    """Mean, sd and count per key and window with a watermark; rows later than ``late`` are dropped by the engine."""
    x = F.when(~F.isnan(value), F.col(value))
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return w.agg(F.avg(x).alias("avg"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
