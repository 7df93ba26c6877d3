"""Offline scoring of outputs as they arrive: row scores without state, and summaries over event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import Metric, details


def scored(stream: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """The row scores of a stream of EVAL rows."""
    return details(stream, metrics)


def windowed_means(stream: DataFrame, metrics: Sequence[Metric], score: str, time: str = "ts", window: str = "10 minutes", late: str = "1 hour", category: str | None = None) -> DataFrame:
    """``start, [category], mean, n`` of one score by window; rows later than ``late`` are dropped."""
    keys = [F.window(time, window).alias("w"), *([F.col(category).alias("category")] if category else [])]
    means = scored(stream.withWatermark(time, late), metrics).groupBy(*keys).agg(F.avg(F.col(score).cast("double")).alias("mean"), F.count("*").alias("n"))
    return means.select(F.col("w.start").alias("start"), *(["category"] if category else []), "mean", "n")
