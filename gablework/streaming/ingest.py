"""Message stream to listing tables.

Every micro-batch is decoded, normalised, validated and appended to five logs, and the writes are accounted for.
A log keeps one folder per batch that is overwritten when the batch is replayed after a failure, so at-least-once
delivery leaves no duplicates. "The row of a url" is a view over a log: its last arrival. ``compact`` writes that view down as a
snapshot in a folder of its own; later reads and snapshots take the newest complete one and newer batches only.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import fixed
from ..operators import routing
from ..operators.normalize import normalize, validate
from ..operators.upsert import latest_by_key, merge_fields
from ..session import checkpoint_folder

LOGS = ["listings_raw", "training_features", "invalid_records", "dlq_raw", "feature_messages"]
ARRIVAL = routing.POSITION


def _append(df: DataFrame, base: str, log: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{base}/{log}/batch={batch}")


@dataclass
class Writes:
    """What one micro-batch wrote: per log the rows, the seconds, and the error of a write that failed.

    Rows that a log could not take become dead letters, with the payload or its normalised form, so the batch goes
    on and nothing is lost. The dead letters and the account itself must be written, or the batch fails as a whole
    and is repeated.
    """

    base: str
    batch: int
    account: list[tuple[str, int, float, str | None]] = field(default_factory=list)
    letters: list[DataFrame] = field(default_factory=list)

    def append(self, rows: DataFrame, log: str, normalized: bool | None = None) -> None:
        """Write a log. ``normalized`` says what its rows are if they have to become dead letters; None: they do not."""
        started = time.monotonic()
        try:
            _append(rows, self.base, log, self.batch)
            # Counted from the footers of what was written.
            written, error = rows.sparkSession.read.parquet(f"{self.base}/{log}/batch={self.batch}").count(), None
        except Exception as failure:
            if normalized is None:
                raise
            written, error = rows.count(), f"{type(failure).__name__}: {str(failure).splitlines()[0][:300]}"
            self.letters.append(routing.failed_writes(rows, F.lit(error), normalized))
        self.account.append((log, written, time.monotonic() - started, error))

    def close(self, spark: SparkSession, dead: DataFrame) -> None:
        for more in self.letters:
            dead = dead.unionByName(more)
        self.append(dead, "dlq_raw")
        rows = spark.createDataFrame(self.account, "log string, rows long, seconds double, error string")
        _append(rows, self.base, "write_account", self.batch)


def store_batch(messages: DataFrame, batch: int, base: str, now: Column | None = None) -> None:
    """Write one micro-batch of messages to all logs. The decoded batch is cached for its several outputs."""
    writes = Writes(base, batch)
    decoded = routing.decode(messages).persist()
    try:
        good = decoded.where("error is null")
        fields = routing.raw_fields(good)
        checked = validate(normalize(fields, now, keep=routing.POSITION)).persist()
        try:
            raw = good.select(
                F.try_variant_get("payload", "$.url", "string").alias("url"), F.col("value").cast("string"), *routing.POSITION
            )
            writes.append(raw, "listings_raw", normalized=False)
            writes.append(checked.where(F.size("validation_errors") == 0).drop("validation_errors"), "training_features", normalized=True)
            writes.append(checked.where(F.size("validation_errors") > 0), "invalid_records", normalized=True)
            writes.append(routing.feature_envelope(checked), "feature_messages")
            writes.close(messages.sparkSession, routing.dead_letters(decoded.where("error is not null")))
            checkpoint = routing.offset_checkpoint(decoded, fixed.CONSUMER_GROUP)
            _append(checkpoint.withColumn("updated_at", F.current_timestamp()), base, "offset_checkpoint", batch)
        finally:
            checked.unpersist()
    finally:
        decoded.unpersist()


#: Logs whose rows count as written to a store; messages and dead letters are other sinks.
STORES = ["listings_raw", "training_features", "invalid_records"]


def write_totals(spark: SparkSession, base: str) -> DataFrame:
    """(name, value): rows written to the stores, rows that could not be, and the time and number of batches."""
    rows = log(spark, base, "write_account", keep_batch=True)
    stores, failed = F.col("log").isin(STORES), F.col("error").isNotNull()
    sums = rows.agg(
        F.coalesce(F.sum(F.when(stores & ~failed, F.col("rows"))), F.lit(0)).cast("double").alias(fixed.WRITES_OK),
        F.coalesce(F.sum(F.when(stores & failed, F.col("rows"))), F.lit(0)).cast("double").alias(fixed.WRITES_FAILED),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias(fixed.DURATION_SUM),
        F.count_distinct("batch").cast("double").alias(fixed.DURATION_COUNT),
    )
    return sums.unpivot([], sums.columns, "name", "value")


class IngestCounters(StreamingQueryListener):
    """Totals of the running session's ingest queries, out of their progress: consumed messages, batches, seconds, and
    the last offset met."""

    def __init__(self):
        self.consumed = self.batches = 0
        self.seconds = 0.0
        self.last_offset: int | None = None
        self.failure: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("ingest")
        if seen is not None and seen["consumed"]:
            self.consumed += seen["consumed"]
            self.batches += 1
            self.seconds += event.progress.batchDuration / 1000
            self.last_offset = max(filter(lambda x: x is not None, (self.last_offset, seen["last_offset"])), default=None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failure = event.exception


def default_checkpoint(spark: SparkSession, base: str) -> str:
    name = hashlib.sha256(base.rstrip("/").encode()).hexdigest()[:20]
    return f"{checkpoint_folder(spark).rstrip('/')}/ingest-{name}"


def start_ingest(
    messages: DataFrame, base: str, checkpoint: str | None = None, now: Column | None = None, continuous: bool = False
) -> StreamingQuery:
    """Start the stream. Not ``continuous``: process what is there, then stop.

    Batches are as large as the source makes them; bound them there (maxFilesPerTrigger, maxOffsetsPerTrigger). The
    default checkpoint is named after the target, so streams into different targets never share one.
    """
    # Counters of every batch, for query progress and listeners.
    observed = messages.observe("ingest", F.count("*").alias("consumed"), F.max("offset").alias("last_offset"))
    writer = observed.writeStream.option(
        "checkpointLocation", checkpoint or default_checkpoint(messages.sparkSession, base)
    ).foreachBatch(lambda df, batch: store_batch(df, batch, base, now))
    writer = writer.trigger(processingTime="1 second") if continuous else writer.trigger(availableNow=True)
    return writer.start()


def _batches(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(f"{base}/{name}")


def log(spark: SparkSession, base: str, name: str, keep_batch: bool = False) -> DataFrame:
    rows = _batches(spark, base, name)
    return rows if keep_batch else rows.drop("batch")


def newest_snapshot(spark: SparkSession, target: str) -> int | None:
    """Last batch in the newest complete snapshot; one that a crash has cut short has no success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    done = [
        int(entry.getPath().getName().removeprefix("upto="))
        for entry in files.listStatus(path)
        if entry.getPath().getName().startswith("upto=")
        and files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def _last_arrivals(spark: SparkSession, base: str, name: str, target: str | None) -> DataFrame:
    upto = None if target is None else newest_snapshot(spark, target)
    rows = _batches(spark, base, name)
    if upto is not None:
        newer = rows.where(F.col("batch") > upto).drop("batch")
        rows = newer.unionByName(spark.read.parquet(f"{target}/upto={upto}"))
    return latest_by_key(rows.drop("batch"), ["url"], ARRIVAL, drop_order=False)


def stored(spark: SparkSession, base: str, name: str, target: str | None = None) -> DataFrame:
    """Current rows of a keyed table: the last arrival per url. A url that turned invalid keeps its last valid row.

    With ``target``, the folder that ``compact`` writes to, only batches after its newest snapshot are aggregated.
    """
    return _last_arrivals(spark, base, name, target).drop(*ARRIVAL)


def stored_raw_fields(spark: SparkSession, base: str) -> DataFrame:
    """Raw fields per url as (url, field, value), merged field by field over all its messages."""
    rows = log(spark, base, "listings_raw")
    fields = F.from_json("value", "map<string,string>")
    return merge_fields(rows, "url", fields, F.struct(*ARRIVAL))


def offsets(spark: SparkSession, base: str) -> DataFrame:
    return log(spark, base, "offset_checkpoint").groupBy("group_id", "topic", "partition").agg(
        F.max("last_processed_offset").alias("last_processed_offset"),
        F.max("committed_offset").alias("committed_offset"),
        F.max("updated_at").alias("updated_at"),
    )


def compact(spark: SparkSession, base: str, name: str, target: str) -> str:
    """Write the current rows of a log as a new snapshot and give its folder; older snapshots stay readable."""
    newest = _batches(spark, base, name).agg(F.max("batch")).first()[0]
    folder = f"{target}/upto={newest}"
    if newest is not None and newest != newest_snapshot(spark, target):
        _last_arrivals(spark, base, name, target).write.mode("overwrite").parquet(folder)
    return folder
