"""Exact dedup by heavy-hitter split.

A Misra-Gries summary per partition, merged by addition, names the few digests that may be frequent. Their groups
are counted exactly with map-side aggregation only, and the winners are broadcast, so rows of frequent texts are
never shuffled. All other digests, none of which is frequent, are grouped and joined by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

LEAST = -(2**63)


def misra_gries(values: Iterator, counters: int) -> dict:
    """At most ``counters`` values with counts; a value seen f times of n keeps at least f - n / (counters + 1)."""
    kept: dict = {}
    for value in values:
        if value in kept:
            kept[value] += 1
        elif len(kept) < counters:
            kept[value] = 1
        else:
            kept = {v: n - 1 for v, n in kept.items() if n > 1}
    return kept


def frequent(rows: DataFrame, column: str, counters: int) -> DataFrame:
    """Values that may make up 2 / (counters + 1) of the rows or more: every such value, at most counters + 1 in all.

    Each partition loses at most its n / (counters + 1) of a value, so the sums lose at most that share of all rows.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = misra_gries((bytes(v) for batch in batches for v in batch[column]), counters)
        yield pd.DataFrame({column: list(kept), "held": list(kept.values())})

    least = rows.count() / (counters + 1)
    held = rows.select(column).mapInPandas(summarise, f"{column} binary, held long")
    summed = held.groupBy(column).agg(F.sum("held").alias("held"))
    return summed.where((F.col("held") >= least) & (F.col("held") > 1)).select(column)


def groups(rows: DataFrame) -> DataFrame:
    """Per digest: rows, largest id and the one row that stays (nulls of the id come last)."""
    order = F.coalesce("doc_id", F.lit(LEAST))
    return rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("row", order).alias("keep_row")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1023) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays;
    a null id ranks below all others, and of rows that share both id and text exactly one stays. An empty table
    gives an empty result. The broadcast tables hold at most ``counters`` + 1 rows of fixed width.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    hot = stored(frequent(rows, "digest", counters))
    winners = stored(groups(rows.join(F.broadcast(hot), "digest", "left_semi")))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(hot), "digest", "left_anti")
    light = rest.join(groups(rest), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


EXACT_SQL = """
WITH d AS (
  SELECT doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256)
"""
