"""Streaming aggregates with bounded state: hourly volumes, feature statistics, unseen keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_volume(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows per hour; an hour is emitted once the watermark has passed it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour"))
        .agg(F.count("*").alias("rows"))
        .select(F.col("window.start").alias("hour"), "rows")
    )


def feature_stats(features: DataFrame, ts: str, late: str = "1 hour", length: str = "1 hour") -> DataFrame:
    """Candidates and mean price by property type and province per window."""
    return (
        features.withWatermark(ts, late)
        .groupBy(F.window(ts, length), "property_type", "province_slug")
        .agg(
            F.count("*").alias("rows"),
            F.count_if("is_model_candidate").alias("candidates"),
            F.avg("price_vnd").alias("avg_price"),
        )
        .select(F.col("window.start").alias("window_start"), "property_type", "province_slug", "rows", "candidates", "avg_price")
    )


def unseen(links: DataFrame, key: str, ts: str, remember: str = "7 days") -> DataFrame:
    """Each key once within the remembered time."""
    return links.withWatermark(ts, remember).dropDuplicatesWithinWatermark([key])
