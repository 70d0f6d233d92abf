"""Helpers shared by the text operators.

All operators take their identifier and text columns by name and look at nothing else, so extra columns of any
name do no harm. Texts are compared after lower-casing A-Z only; words are maximal runs of ASCII letters, digits
and characters outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; the built-in lower is the faster way for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """Lower-cased words in order; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read again: computed once, and safe when executors are lost.

    Unlike a checkpoint the files are compressed and scans of them read only the columns they need. Like a
    checkpoint they stay until the owner of the folder clears it.
    """
    return written(df, compression)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, stored, with a number of their own in a column of the name returned: rows of equal or null id differ."""
    row = unused(df, "row_no")
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "zstd"), row
