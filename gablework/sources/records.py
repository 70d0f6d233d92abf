"""Record files, message streams and dataset exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.routing import RAW_FIELDS

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def json_array_records(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Records of JSON array files with VARIANT fields, so numbers and texts stay apart. One file is one array."""
    parsed = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = parsed.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("item"))
    return items.select(*[F.try_variant_get("item", f"$.{n}", "variant").alias(n) for n in fields or RAW_FIELDS])


def message_stream(spark: SparkSession, source_format: str = "kafka", **options: str) -> DataFrame:
    """Unbounded keyed messages from the earliest offset on.

    ``source_format`` may be any streaming format with the message columns; "kafka" needs its connector.
    """
    reader = spark.readStream.format(source_format)
    if source_format == "kafka":
        options = {"startingOffsets": "earliest", **options}
        loaded = reader.options(**options).load()
        return loaded.select(
            F.col("key").cast("string").alias("key"), "value", "topic", "partition", "offset", "timestamp"
        )
    path = options.pop("path")
    return reader.schema(MESSAGE_SCHEMA).options(**options).load(path)


def export_dataset(features: DataFrame, path: str, kind: str = "parquet", only_candidates: bool = True) -> None:
    """Training dataset as parquet, csv (UTF-8 with header, no byte order mark) or jsonl."""
    rows = features.where("is_model_candidate") if only_candidates else features
    writer = rows.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export format {kind}")
