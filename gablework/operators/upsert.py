"""Keyed tables out of append-only logs: the last arrival per key, whole rows or field by field.

Both are aggregations, not windows: every map task first reduces its own rows to one per key, so a key that
holds a third of all rows still sends one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], drop_order: bool = True) -> DataFrame:
    """Last arrived row of every key; all NULL keys are one key. ``order`` must be a total order per key."""
    dropped = set(order) if drop_order else set()
    kept = [name for name in df.columns if name not in keys and name not in dropped]
    last = F.max_by(F.struct(*kept), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.`{name}`").alias(name) for name in kept])


def latest_branches(
    validated: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None, only: str | None = None
) -> DataFrame:
    """Last valid and last rejected version per key in one aggregation: (keys, valid STRUCT, invalid STRUCT).

    Validity decides which order values take part instead of filtering first: a filter would be pushed below
    the normalisation and repeat it. The structs travel through the shuffle, so name the ``columns`` that are read
    later, and the ``only`` branch if it is one: all else is then neither computed nor sent.
    """
    kept = [name for name in validated.columns if name not in keys and name not in order]
    if columns is not None:
        kept = [name for name in kept if name in columns]
    ok = F.size("validation_errors") == 0
    position, row = F.struct(*order), F.struct(*kept) if kept else F.struct(F.lit(True).alias("_"))
    picks = {"valid": F.when(ok, position), "invalid": F.when(~ok, position)}
    return validated.groupBy(*keys).agg(*[F.max_by(row, at).alias(name) for name, at in picks.items() if only in (None, name)])


def branch(branches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One branch ("valid" or "invalid") of ``latest_branches`` as a flat table."""
    rows = branches.where(F.col(name).isNotNull()).select(*keys, f"{name}.*").drop("_")
    return rows.drop("validation_errors") if name == "valid" else rows


def merge_fields(df: DataFrame, key: str, fields: Column, order: Column) -> DataFrame:
    """Field-level merge of MAP<STRING, value> payloads into rows (key, field, value).

    A field keeps its last arrived value, explicit NULLs included; payloads without the field leave it alone.
    """
    entries = df.select(F.col(key), order.alias("_order"), F.explode(fields).alias("field", "value"))
    return entries.groupBy(key, "field").agg(F.max_by("value", "_order").alias("value"))


def wide_fields(merged: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Merged fields as one row per key with the named columns."""
    picks = [F.any_value(F.when(F.col("field") == name, F.col("value")), True).alias(name) for name in names]
    return merged.groupBy(key).agg(*picks)


def in_both(features: DataFrame, invalid: DataFrame, key: str = "url") -> DataFrame:
    """Keys whose last valid version stays stored although a version was rejected too."""
    return features.join(invalid.select(key), key, "left_semi")
