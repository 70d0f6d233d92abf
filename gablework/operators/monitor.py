"""Rates, alerts, gauges and histograms over metric samples (ts, instance, name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .timeline import counter_increase, firing, last_state

SERIES = ["instance", "name"]
FIVE_MINUTES, HOUR = 300.0, 3600.0


def counter_rate(samples: DataFrame, names: list[str], window: float = FIVE_MINUTES) -> DataFrame:
    """(ts, instance, name, rate): growth per second over the window, at every sample."""
    grown = counter_increase(samples.where(F.col("name").isin(names)), SERIES, window)
    return grown.select("ts", "instance", "name", (F.col("increase") / float(window)).alias("rate"))


def _side_by_side(rates: DataFrame, columns: dict[str, str], value: str = "rate") -> DataFrame:
    """Several series of one scrape as columns of one row."""
    return rates.groupBy("instance", "ts").agg(
        *[F.max(F.when(F.col("name") == name, F.col(value))).alias(column) for column, name in columns.items()]
    )


def alert_error_rate(samples: DataFrame, limit: float = 0.05, hold: float = FIVE_MINUTES) -> DataFrame:
    rates = _side_by_side(
        counter_rate(samples, [fixed.FAILED, fixed.CONSUMED]), {"failed": fixed.FAILED, "consumed": fixed.CONSUMED}
    )
    rows = rates.select("instance", "ts", (F.col("failed") / F.greatest("consumed", F.lit(1.0))).alias("value"))
    return firing(rows, ["instance"], F.col("value") > limit, hold)


def alert_lag(samples: DataFrame, limit: float = 1000, hold: float = FIVE_MINUTES) -> DataFrame:
    rows = samples.where(F.col("name") == fixed.LAG).select("instance", "ts", "value")
    return firing(rows, ["instance"], F.col("value") > limit, hold)


def mean_duration(samples: DataFrame, total: str, count: str, window: float) -> DataFrame:
    rates = _side_by_side(counter_rate(samples, [total, count], window), {"total": total, "n": count})
    return rates.select("instance", "ts", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("value"))


def alert_duration(samples: DataFrame, limit: float = 5, hold: float = FIVE_MINUTES) -> DataFrame:
    rows = mean_duration(samples, fixed.DURATION_SUM, fixed.DURATION_COUNT, FIVE_MINUTES)
    return firing(rows, ["instance"], F.col("value") > limit, hold)


def alert_training_failed(samples: DataFrame, hold: float = 600) -> DataFrame:
    grown = counter_increase(samples.where(F.col("name") == fixed.RUNS_FAILED), SERIES, HOUR)
    rows = grown.select("instance", "ts", F.col("increase").alias("value"))
    return firing(rows, ["instance"], F.col("value") > 0, hold)


def alert_stale(samples: DataFrame, limit: float = 43200, hold: float = 900) -> DataFrame:
    """Age of the last successful training, judged at every sample of it."""
    rows = samples.where(F.col("name") == fixed.LAST_SUCCESS).select(
        "instance", "ts", (F.col("ts") - F.col("value")).alias("value")
    )
    return firing(rows, ["instance"], F.col("value") > limit, hold)


def alert_write_failures(samples: DataFrame, hold: float = FIVE_MINUTES) -> DataFrame:
    rows = counter_rate(samples, [fixed.WRITES_FAILED]).select("instance", "ts", F.col("rate").alias("value"))
    return firing(rows, ["instance"], F.col("value") > 0, hold)


# Alert names and severities.
ALERTS = {
    "HighProcessingErrorRate": ("critical", alert_error_rate),
    "HighKafkaConsumerLag": ("warning", alert_lag),
    "ProcessingDurationAnomaly": ("warning", alert_duration),
    "ModelTrainingFailed": ("warning", alert_training_failed),
    "ModelTrainingStale": ("warning", alert_stale),
    "DatabaseWriteFailures": ("critical", alert_write_failures),
}


def alert_episodes(samples: DataFrame) -> DataFrame:
    """Every firing episode of every alert: (alert, severity, instance, since, fired_at, last_ts, samples)."""
    parts = None
    for name, (severity, rule) in ALERTS.items():
        fired = rule(samples).where(F.col("state") == "firing")
        episodes = fired.groupBy("instance", "since").agg(
            F.min("ts").alias("fired_at"), F.max("ts").alias("last_ts"), F.count("*").alias("samples")
        )
        rows = episodes.select(
            F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "instance", "since", "fired_at", "last_ts", "samples"
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def latest_values(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Last value of every series."""
    chosen = samples.where(F.col("name").isin(names)) if names else samples
    return chosen.groupBy(*SERIES).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def histogram(df: DataFrame, value: Column, bounds: list[float], group: str | None = None) -> DataFrame:
    """Cumulative buckets, count and sum of a value, optionally per group, in one pass."""
    buckets = [F.count_if(value <= bound).alias(f"le_{bound:g}".replace(".", "_")) for bound in bounds]
    aggregates = [F.count(value).alias("count"), F.round(F.sum(value), 4).alias("sum"), *buckets]
    return df.groupBy(group).agg(*aggregates) if group else df.agg(*aggregates)


def threshold_alerts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Every series against a small table of rules (name, comparator, threshold, hold, severity), as of its last sample:
    value, breached, since when without a break, and state: inactive, pending, or firing after ``hold`` seconds."""
    value, threshold = F.col("value"), F.col("threshold")
    broken = (
        ((F.col("comparator") == ">") & (value > threshold))
        | ((F.col("comparator") == "<") & (value < threshold))
        | ((F.col("comparator") == "=") & (value == threshold))
    )
    judged = samples.join(rules, "name").withColumn("breached", F.coalesce(broken, F.lit(False)))
    rule = ["instance", "name", "comparator", "threshold", "hold", "severity"]
    return last_state(judged, rule, F.col("breached"), F.col("hold"), ["value", "breached"]).select(
        *rule, "ts", "value", "breached", "since", "state"
    )


def families_of(codes: DataFrame, code: str, families: DataFrame) -> DataFrame:
    """Error family of every code. Ranges are given in hundreds, so the range join becomes an equi-join on them."""
    hundreds = F.explode(F.sequence(F.floor(F.col("first") / 100), F.floor(F.col("last") / 100)))
    ranged = families.select("family", "first", "last", hundreds.alias("_hundred"))
    inside = (F.floor(F.col(code) / 100) == F.col("_hundred")) & F.col(code).between(F.col("first"), F.col("last"))
    return codes.join(ranged, inside, "left").drop("_hundred", "first", "last")
