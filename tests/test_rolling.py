import math
import random

from pyspark.sql import functions as F

from gablework.operators import monitor, timeline


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_increase_of_dense_series_has_no_sliding_frame(spark):
    """A sliding frame is summed anew at every sample, so its cost grows with the square of the samples in a window."""
    df = spark.createDataFrame([("s", float(t), float(t % 50)) for t in range(400)], "name string, ts double, value double")
    grown = timeline.counter_increase(df, ["name"], 300)
    assert "specifiedwindowframe" in plan_of(grown) and "RangeFrame, -" not in plan_of(grown)
    values = [float(t % 50) for t in range(400)]
    for row in grown.collect():
        inside = values[max(0, int(row.ts) - 300) : int(row.ts) + 1]
        steps = [b if b < a else b - a for a, b in zip(inside, inside[1:])]
        assert row.increase == (sum(steps) if len(inside) > 1 else None)


def test_increase_with_values_that_are_missing_or_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    values = [1.0, 4.0, None, 6.0, nan, 8.0, 9.0, inf, 2.0, 5.0, 7.5, None, None, None, 1.0]
    rows = [("s", 10.0 * i, v) for i, v in enumerate(values)] + [("s", None, 3.0), (None, 0.0, 1.0), (None, 5.0, 2.5)]
    df = spark.createDataFrame(rows, "name string, ts double, value double")
    got = {(r.name, r.ts): r.increase for r in timeline.counter_increase(df, ["name"], 20, chunk=1000).select("name", "ts", "increase").collect()}
    assert len(got) == len(rows) - 1 and got[(None, 5.0)] == 1.5

    def same(a, b):
        return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))

    # Null steps do not count; values that are not finite are gone again with their window.
    wanted = [None, 3.0, 3.0, 0.0, nan, nan, nan, inf, inf, nan, 5.5, 2.5, 0.0, None, None]
    found = [got[("s", 10.0 * i)] for i in range(len(values))]
    assert all(same(a, b) for a, b in zip(found, wanted)), found


def test_last_state_equals_the_last_row_of_firing(spark):
    draw, rows = random.Random(4), []
    for name, share in (("a", 0.97), ("b", 0.5), (None, 1.0), ("d", 0.0)):
        rows += [(name, 100.0 * t + draw.random(), None if draw.random() < 0.02 else draw.random() < share) for t in range(300)]
    rows += [("none", None, True), ("d", None, True)]
    df = spark.createDataFrame(rows, "name string, ts double, c boolean")
    last = F.max_by(F.struct("c", "since", "state"), "ts").alias("l")
    every = timeline.firing(df, ["name"], F.col("c"), 150).groupBy("name").agg(last, F.max("ts").alias("ts"))
    wanted = {tuple(r) for r in every.select("name", "ts", "l.*").collect()}
    found = timeline.last_state(df, ["name"], F.col("c"), 150, ["c"])
    assert {tuple(r) for r in found.collect()} == {t if t[4] else (*t[:4], "inactive") for t in wanted}


def test_threshold_alerts_sort_no_series(spark):
    samples = spark.createDataFrame([(float(t), "i", "m", float(t % 7)) for t in range(100)], "ts double, instance string, name string, value double")
    rules = spark.createDataFrame([("m", "<", 5.0, 1.0, "HIGH")], "name string, comparator string, threshold double, hold double, severity string")
    found = monitor.threshold_alerts(samples, rules)
    assert "Window" not in plan_of(found)
    (row,) = found.collect()
    assert (row.ts, row.value, row.breached, row.since, row.state) == (99.0, 1.0, True, 98.0, "firing")
