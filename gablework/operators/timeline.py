"""Rolling windows and held conditions over long series, split by time so that no series is one task.

A series may hold a third of all samples. Windows are therefore partitioned by (series, time chunk); what a
chunk needs from its past is either copied in (rolling windows look back a fixed time) or carried over from
one summary row per chunk (runs may be arbitrarily long). Results equal those of unsplit windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _chunk(ts: Column, seconds: float) -> Column:
    return F.floor(ts / F.lit(float(seconds)))


def counter_increase(
    samples: DataFrame, series: list[str], window: float, ts: str = "ts", value: str = "value", chunk: float | None = None
) -> DataFrame:
    """Add ``increase``: growth of a counter within the last ``window`` seconds, resets counted from zero.

    Only steps between two samples inside the window count and nothing is extrapolated to its edges; a lone
    sample gives NULL. (series, ts) must be unique. The cost of a sample does not depend on how many share its window:
    growth is the difference of two running sums, at the sample and at the first sample of its window, and the latter
    is found by sorting the windows' starts among the samples.
    """
    span_us, chunk_us = int(window * 1e6), int((chunk or max(window, 3600)) * 1e6)
    if chunk_us < span_us:
        raise ValueError("chunk must not be shorter than the window")
    timed = samples.withColumn("_us", F.round(F.col(ts) * 1e6).cast("bigint")).where("_us is not null")
    own = F.floor(F.col("_us") / chunk_us)
    # A sample also serves the windows of the next chunk when it is close enough to that chunk's start.
    near_end = (own + 1) * chunk_us - F.col("_us") <= span_us
    copies = timed.withColumns(
        {"_own": own, "_chunk": F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))}
    )
    keys = [*series, "_chunk"]
    ordered = Window.partitionBy(*keys).orderBy("_us")
    current, previous = F.col(value).cast("double"), F.lag(F.col(value).cast("double")).over(ordered)
    copies = copies.withColumn("_step", F.when(current < previous, current).otherwise(current - previous))
    step, endless = F.col("_step"), F.lit(float("inf"))
    # Whole and broken parts are summed apart, so that a difference of long sums loses no digits. Values that are no
    # finite numbers would spoil a running sum for good, so they are counted instead.
    finite = F.when(F.abs(step) < endless, step).otherwise(0.0)
    counted = {
        "whole": F.sum(finite - finite % 1),
        "part": F.sum(finite % 1),
        "steps": F.count(step),
        "nan": F.count_if(F.isnan(step)),
        "up": F.count_if(step == endless),
        "down": F.count_if(step == -endless),
    }
    upto_row = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct(*[c.over(upto_row).alias(n) for n, c in counted.items()], step.alias("step")).alias("_here")
    until = F.struct(F.count("*").over(ordered).alias("n"), *[c.over(ordered).alias(n) for n, c in counted.items()]).alias("_until")
    running = copies.select("*", F.row_number().over(ordered).alias("_n"), here, until)

    def mark(row: Column, at: Column, found: Column) -> Column:
        return F.struct(row.alias("_row"), at.alias("_at"), F.col("_n"), found.alias("_found"))

    first = F.struct("_n", "_here")
    row = F.struct(*samples.columns, "_until")
    sample = mark(F.lit(None), F.col("_us"), first)
    start = mark(row, F.col("_us") - span_us, F.lit(None))
    marks = F.explode(F.when(F.col("_chunk") == F.col("_own"), F.array(sample, start)).otherwise(F.array(sample)))
    placed = running.select(*keys, marks.alias("_mark")).select(*keys, "_mark.*")
    # Backwards in time, the last sample before a window's start is the first one inside the window.
    backwards = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_row").isNotNull(), F.desc("_n"))
    backwards = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_first", F.last("_found", ignorenulls=True).over(backwards)).where("_row is not null")

    def between(name: str) -> Column:
        return F.col(f"_row._until.{name}") - F.col(f"_first._here.{name}")

    began = F.col("_first._here.step")
    odd = F.coalesce(F.isnan(began) | (F.abs(began) == endless), F.lit(False)) | (between("nan") > 0)
    grown = (
        F.when((between("steps") == 0) & began.isNull(), None)
        .when(odd | ((between("up") > 0) & (between("down") > 0)), F.lit(float("nan")))
        .when(between("up") > 0, endless)
        .when(between("down") > 0, -endless)
        .otherwise(between("whole") + between("part"))
    )
    several = F.col("_row._until.n") > F.col("_first._n")
    return placed.select(*[F.col(f"_row.`{c}`").alias(c) for c in samples.columns], F.when(several, grown).alias("increase"))


def held_since(df: DataFrame, series: list[str], condition: Column, ts: str = "ts", chunk: float = 3600) -> DataFrame:
    """Add ``since``: start of the unbroken run in which the condition holds, NULL where it does not."""
    keys = [*series, "_chunk"]
    ordered = Window.partitionBy(*keys).orderBy(ts)
    rows = df.withColumns({"_chunk": _chunk(F.col(ts), chunk), "_holds": F.coalesce(condition, F.lit(False))})
    broken = F.sum((~F.col("_holds")).cast("int")).over(ordered)
    rows = rows.withColumn("_broken", broken)
    run = Window.partitionBy(*keys, "_broken")
    rows = rows.withColumn("_start", F.min(F.when(F.col("_holds"), F.col(ts))).over(run))

    # One row per chunk: did the condition break, and when did the run that is open at the end begin?
    ends = rows.groupBy(*keys).agg(
        F.max("_broken").alias("_breaks"), F.max_by("_start", ts).alias("_open"), F.max_by("_holds", ts).alias("_on")
    )
    past = Window.partitionBy(*series).orderBy("_chunk")
    ends = ends.withColumn("_segment", F.sum((F.col("_breaks") > 0).cast("int")).over(past))
    inner = Window.partitionBy(*series, "_segment").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    open_run = F.when(F.col("_on"), F.col("_open"))
    # A chunk that breaks starts a new segment, but its own first run still continues the segment before it.
    ends = ends.withColumns(
        {
            "_within": F.min(open_run).over(inner),
            "_until_now": F.min(open_run).over(
                Window.partitionBy(*series, "_segment").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    ends = ends.withColumn(
        "_carry", F.when(F.col("_breaks") > 0, F.lag("_until_now").over(past)).otherwise(F.col("_within"))
    )
    # NULL is a series of its own, so the keys are compared null-safely.
    sides = ends.select(*[F.col(k).alias(f"_end{i}") for i, k in enumerate(keys)], "_carry")
    same = [F.col(k).eqNullSafe(F.col(f"_end{i}")) for i, k in enumerate(keys)]
    joined = rows.join(sides, same)
    since = F.when(
        F.col("_holds"), F.when(F.col("_broken") == 0, F.coalesce("_carry", "_start")).otherwise(F.col("_start"))
    )
    return joined.withColumn("since", since).drop(
        "_chunk", "_holds", "_broken", "_start", "_carry", *[f"_end{i}" for i in range(len(keys))]
    )


def _state(ts: Column, since: Column, hold: float | Column) -> Column:
    long_enough = ts - since >= (hold if isinstance(hold, Column) else float(hold))
    return F.when(since.isNull(), "inactive").when(long_enough, "firing").otherwise("pending")


def firing(df: DataFrame, series: list[str], condition: Column, hold: float | Column, ts: str = "ts", chunk: float = 3600) -> DataFrame:
    """Add ``since`` and ``state``: inactive, pending, or firing once the condition has held for ``hold`` seconds."""
    rows = held_since(df, series, condition, ts, chunk)
    return rows.withColumn("state", _state(F.col(ts), F.col("since"), hold))


def last_state(df: DataFrame, series: list[str], condition: Column, hold: float | Column, values: list[str], ts: str = "ts") -> DataFrame:
    """Per series its last ``ts`` with ``values``, ``since`` and ``state`` as ``firing`` gives them there.

    Two aggregations: the last break of the condition, then its first sample from there on. No series is sorted or
    buffered; the table of one row per series is stored, so that its true size decides how it is joined.
    """
    rows = df.withColumn("_holds", F.coalesce(condition, F.lit(False)))
    last = F.max_by(F.struct(*values, "_holds"), ts).alias("_last")
    broken = F.max(F.when(~F.col("_holds"), F.col(ts))).alias("_broken")
    ends = written(rows.groupBy(*series).agg(last, F.max(ts).alias("_end"), broken))

    def same(side: DataFrame, *columns: str) -> tuple[DataFrame, list[Column]]:
        """A side of a join whose keys have names of their own, and the null-safe comparison with them."""
        renamed = side.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(series)], *columns)
        return renamed, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(series)]

    held = rows.where("_holds").join(*same(ends, "_broken"))
    begun = held.where(F.col("_broken").isNull() | (F.col(ts) >= F.col("_broken"))).groupBy(*series).agg(F.min(ts).alias("_since"))
    judged = ends.join(*same(begun, "_since"), "left").select(*series, F.col("_end").alias(ts), "_last", "_since")
    judged = judged.withColumn("since", F.when(F.col("_last._holds"), F.col("_since")))
    state = _state(F.col(ts), F.col("since"), hold)
    return judged.select(*series, ts, *[F.col(f"_last.`{c}`").alias(c) for c in values], "since", state.alias("state"))
