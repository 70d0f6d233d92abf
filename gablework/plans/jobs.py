"""Batch entry points: normalise a file, write the quality report, export a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.normalize import normalize
from ..operators.quality import report
from ..sources.records import export_dataset, json_array_records

__all__ = ["export_dataset", "normalize_file", "write_report"]


def normalize_file(spark: SparkSession, path: str, output: str | None = None, now: Column | None = None) -> DataFrame:
    """Normalise the records of JSON array files; optionally write them as JSON lines with nulls kept."""
    rows = normalize(json_array_records(spark, path), now)
    if output:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(output)
    return rows


def write_report(features: DataFrame, output: str, top: int = 20) -> None:
    """The quality report as a text file with one JSON document."""
    report(features, top).coalesce(1).write.mode("overwrite").text(output)
