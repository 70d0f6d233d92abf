import random

import pytest
from pyspark.sql import functions as F

from gablework import fixed
from gablework.operators import monitor
from gablework.streaming import alerts

START = 1_700_000_000
SCHEMA = "ts double, instance string, name string, value double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def samples(seed=1, minutes=240):
    """Counters with resets, gauges that cross their limits, and gaps, for two instances."""
    draw, rows = random.Random(seed), []
    for instance in ("a", "b"):
        counters = dict.fromkeys([fixed.FAILED, fixed.CONSUMED, fixed.DURATION_SUM, fixed.DURATION_COUNT, fixed.RUNS_FAILED, fixed.WRITES_FAILED], 0.0)
        bad, success = False, float(START)
        for minute in range(minutes):
            if draw.random() < 0.05:
                bad = not bad
            if draw.random() < 0.03:
                counters = dict.fromkeys(counters, 0.0)
            if draw.random() < 0.1:
                continue
            at = START + 60.0 * minute + draw.choice([0.0, 0.25])
            counters[fixed.CONSUMED] += draw.randint(0, 300)
            counters[fixed.FAILED] += draw.randint(0, 90) if bad else 0
            counters[fixed.DURATION_COUNT] += draw.randint(0, 3)
            counters[fixed.DURATION_SUM] += draw.choice([1.0, 30.0]) if bad else 0.5
            counters[fixed.RUNS_FAILED] += bad and draw.random() < 0.1
            counters[fixed.WRITES_FAILED] += bad and draw.random() < 0.5
            if draw.random() < 0.01:
                success = at
            rows += [(at, instance, name, float(value)) for name, value in counters.items()]
            rows += [(at, instance, fixed.LAG, 2000.0 if bad else 10.0), (at, instance, fixed.LAST_SUCCESS, success - 43_200 + 3_000)]
    return rows


def run(spark, folder, checkpoint, target):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    updates = alerts.alert_stream(stream, alerts.alert_rules(spark), "10 minutes")

    def store(df, batch):
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch_with_late_and_repeated_rows(rocks, tmp_path):
    spark = rocks
    rows = sorted(samples())
    draw = random.Random(7)
    # Rows arrive up to eight minutes late, some of them twice, and a few far behind the watermark.
    arrivals = sorted((r[0] + draw.uniform(0, 480), r) for r in rows)
    arrivals += [(t + 200, r) for t, r in draw.sample(arrivals, 200)]
    arrivals.sort()
    folder, checkpoint, target = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    parts = [arrivals[i::1] for i in range(1)][0]
    size = -(-len(parts) // 6)
    end = max(r[0] for r in rows)
    heart = (end + 3600, "heart", fixed.LAG, 0.0)  # moves the watermark past all other samples

    def write(name, chosen):
        spark.createDataFrame([r for _, r in chosen], SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{name}")

    folder_glob = f"{folder}/*"
    for i in range(6):
        write(f"p{i}", parts[i * size : (i + 1) * size])
        if i == 2:
            run(spark, folder_glob, checkpoint, target)  # a restart in the middle
    write("p6", [(0, heart)])
    write("p7", [(0, heart), (0, (START + 5.0, "a", fixed.LAG, 9e9))])
    run(spark, folder_glob, checkpoint, target)
    run(spark, folder_glob, checkpoint, target)
    found = alerts.episodes(spark.read.parquet(target).drop("batch"))
    expected = monitor.alert_episodes(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted(tuple(r) for r in df.select("alert", "severity", "instance", "since", "fired_at", "last_ts", "samples").collect())
    assert key(expected) and len({r[0] for r in key(expected)}) >= 5
    assert key(found) == key(expected)


def test_measures():
    past = {"m": [(0, 5.0), (60_000_000, 2.0), (120_000_000, 6.0)], "o": [(120_000_000, 1.0)]}
    rule = {"metric": "m", "other": "o", "window": 120.0}
    now = {"m": 6.0, "o": 1.0}
    by = {k: alerts.measured({**rule, "measure": k}, past, 120_000_000, now) for k in ("value", "age", "increase", "rate", "share", "mean")}
    assert by == {"value": 6.0, "age": 114.0, "increase": 6.0, "rate": 0.05, "share": 0.05, "mean": None}
    assert not alerts.breached(None, ">", 0.0) and alerts.breached(1.0, "=", 1.0) and alerts.breached(0.0, "<", 1.0)
