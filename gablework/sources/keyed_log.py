"""Versions of keyed rows in a bucketed log, and the sorted table of their current rows.

The log's files are bucketed by key, so all versions of a key lie in one bucket. The winner of every key is found on
(key, position) alone, and its row is fetched by position from the same bucket: neither step shuffles, and no other
column is read for versions that lose. A batch is a partition that is overwritten when it is written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class KeyedLog:
    """A log in the session's catalogue. ``position`` orders the versions of a key: one column (then the winners are a
    plain hash aggregation) or several; equal positions are versions of equal standing and must not differ."""

    spark: SparkSession
    table: str
    key: str = "url"
    position: tuple[str, ...] = ("offset",)
    buckets: int = 64
    path: str | None = None  # a folder that driver and executors share; else the warehouse

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch; the same batch again takes the place of the first."""
        if not self.spark.catalog.tableExists(self.table):
            empty = rows.limit(0).withColumn("batch", F.lit(batch).cast("long"))
            options = {f"parquet.bloom.filter.enabled#{self.key}": "true"} | ({"path": self.path} if self.path else {})
            writer = empty.write.format("parquet").options(**options).partitionBy("batch")
            writer.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.table)
        ordered = rows.select(*self.versions().columns)
        self.spark.sql(f"insert overwrite table {self.table} partition (batch = {int(batch)}) select * from {{rows}}", rows=ordered)

    def versions(self) -> DataFrame:
        return self.spark.table(self.table).drop("batch")

    def latest(self, columns: list[str] | None = None, which: Column | None = None, where: Column | None = None) -> DataFrame:
        """The last version of every key, with these columns; null is a key of its own.

        ``which`` says what versions take part (the valid ones, say), ``where`` what winners are wanted: it is pushed
        to the scan of the rows and decides nothing about who wins.
        """
        rows = self.versions()
        names = [c for c in rows.columns if c not in (self.key, *self.position)] if columns is None else columns
        part = rows if which is None else rows.where(which)
        place = F.struct(*self.position) if len(self.position) > 1 else F.col(self.position[0])
        known = part.where(F.col(self.key).isNotNull())
        winners = known.groupBy(F.col(self.key).alias("_key")).agg(F.max(place).alias("_place"))
        # The winner's position is the key's largest, so no second key is needed to find its row: buckets stay as they are.
        matched = known.withColumn("_own", place)
        if where is not None:
            matched = matched.where(where)
        joined = matched.join(winners.hint("shuffle_hash"), (F.col(self.key) == F.col("_key")) & (F.col("_own") >= F.col("_place")))
        found = joined.select(self.key, *names).dropDuplicates([self.key])
        unnamed = part.where(F.col(self.key).isNull())
        whole = list(dict.fromkeys([self.key, *names, *([] if where is None else unnamed.columns)]))
        last = unnamed.agg(F.max_by(F.struct(*whole), place).alias("_last"))
        alone = last.where(F.col("_last").isNotNull()).select("_last.*")
        if where is not None:
            alone = alone.where(where)
        return found.unionByName(alone.select(self.key, *names))


def write_sorted(rows: DataFrame, path: str, order: list[str], bloom: str, parts: int | None = None) -> None:
    """Rows in ranges of ``order``, sorted within, with a Bloom filter on one column: filters on the order skip row
    groups by their statistics, look-ups of a key by the filter."""
    placed = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    options = {f"parquet.bloom.filter.enabled#{bloom}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    placed.sortWithinPartitions(*order).write.mode("overwrite").options(**options).parquet(path)


#: Training reads candidates with a price, so they lie together.
FEATURE_ORDER = ["is_model_candidate", "has_target_price", "province_slug", "url"]


def write_features(features: DataFrame, path: str, parts: int | None = None) -> None:
    """The current feature rows as a stored table for the scans below."""
    write_sorted(features, path, FEATURE_ORDER, "url", parts)


def scan_priced(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Listings with a price; the filter and the columns reach the scan."""
    return spark.read.parquet(path).where(F.col("price_vnd") > 0).select("url", "price_vnd", *columns)


def scan_trainable(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Priced candidates; both filters and the columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col("is_model_candidate") & (F.col("price_vnd") > 0))
    return rows.select("url", "price_vnd", *columns)


def find_url(spark: SparkSession, path: str, url: str) -> DataFrame:
    """The stored row of one listing, found by the Bloom filters and statistics of the row groups."""
    return spark.read.parquet(path).where(F.col("url") == url)
