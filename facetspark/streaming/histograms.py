"""Streaming forms: points arrive one by one, and typed counts or windowed histograms are kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.expressions import bin_of


def typed_counts(points: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """mol_id, type, cnt of a stream (or table) of points: a running one-point histogram."""
    return points.groupBy("mol_id", bin_of(F.col(value), thresholds).alias("type")).agg(F.count("*").alias("cnt"))


def windowed_counts(points: DataFrame, time: str, late: str, window: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """window start, type, cnt with a watermark: state is dropped once points can be no later than `late`."""
    timed = points.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), bin_of(F.col(value), thresholds).alias("type"))
    return timed.agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "type", "cnt")
