import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablework.operators import features, monitor, order_stats, split, timeline
from gablework.operators.evaluate import model_gate, prediction_range, regression_metrics


def test_percentiles_are_exact(spark):
    rng = random.Random(7)
    groups = {
        "heavy": [rng.lognormvariate(0, 8) for _ in range(3001)],
        "hot": [5.0] * 900 + [rng.uniform(0, 10) for _ in range(100)],
        "even": [1.0, 2.0, 3.0, 10.0],
        "single": [4.0],
        "same": [2.0] * 5,
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = order_stats.percentiles(df, "g", "v", fractions)
    for group, values in groups.items():
        for fraction in fractions:
            assert got[(group, fraction)] == pytest.approx(float(np.quantile(values, fraction)), rel=1e-12)
    assert ("none", 0.5) not in got


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None)], "a double, b double")
    assert order_stats.medians(df, ["a", "b"]) == {"a": 2.5, "b": None}


def test_split_is_exact(spark):
    df = spark.range(1003).select(F.concat(F.lit("u"), "id").alias("url"))
    marked = split.mark_test(df, F.col("url")).collect()
    assert sum(r.is_test for r in marked) == math.ceil(1003 * 0.2)
    again = {r.url for r in split.mark_test(df, F.col("url")).where("is_test").collect()}
    assert again == {r.url for r in marked if r.is_test}
    # Refinement below one prefix gives the same cut.
    digests = df.select(split.split_digest(F.col("url")).alias("h"))
    assert order_stats.hash_cut(digests, "h", 77, width=1, enough=2) == sorted(r.h for r in digests.collect())[76]


def series(seed: int, count: int):
    rng = random.Random(seed)
    ts, value, rows = 1_000_000.0, 0.0, []
    for _ in range(count):
        ts += rng.choice([5.0, 20.0, 40.0, 400.0 if rng.random() < 0.05 else 10.0])
        value = rng.uniform(0, 3) if rng.random() < 0.05 else value + rng.choice([0.0, 1.0, 4.0])
        rows.append((ts, value))
    return rows


def plain_increase(rows, window):
    result = []
    for i, (ts, _) in enumerate(rows):
        inside = [v for t, v in rows[: i + 1] if t >= ts - window]
        steps = [b if b < a else b - a for a, b in zip(inside, inside[1:])]
        result.append(sum(steps) if len(inside) > 1 else None)
    return result


def test_increase_over_chunks_equals_plain_windows(spark):
    rows = series(3, 800)
    df = spark.createDataFrame([("s", t, v) for t, v in rows], "name string, ts double, value double")
    # Chunks hardly longer than the window, so that most windows cross a chunk's start.
    got = timeline.counter_increase(df, ["name"], 300, chunk=310).orderBy("ts").collect()
    assert len(got) == len(rows)
    for row, want in zip(got, plain_increase(rows, 300)):
        assert (row.increase is None) == (want is None)
        assert want is None or row.increase == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("share", [0.1, 0.9, 0.995])
def test_held_since_over_chunks_equals_plain_runs(spark, share):
    rng = random.Random(int(share * 1000))
    rows = [(t, rng.random() < share) for t, _ in series(5, 600)]
    df = spark.createDataFrame([("s", t, c) for t, c in rows], "name string, ts double, c boolean")
    got = timeline.held_since(df, ["name"], F.col("c"), chunk=100).orderBy("ts").collect()
    start, wanted = None, []
    for t, holds in rows:
        start = (start if start is not None else t) if holds else None
        wanted.append(start)
    assert [r.since for r in got] == wanted
    states = timeline.firing(df, ["name"], F.col("c"), 300, chunk=100).orderBy("ts").collect()
    assert [r.state for r in states] == [
        "inactive" if s is None else ("firing" if t - s >= 300 else "pending") for (t, _), s in zip(rows, wanted)
    ]


def test_modes_and_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "p string").withColumn("q", F.lit(None).cast("string"))
    assert features.mode_values(features.category_counts(df, ["p", "q"])) == {"p": "a"}
    hot = features.one_hot_entries(
        df.withColumn("k", F.monotonically_increasing_id()), "k", ["p"], spark.createDataFrame([("p", "a")], "feature string, value string")
    )
    assert hot.count() == 2
    texts = spark.createDataFrame([(1, "nhà đẹp nhà"), (2, "đẹp"), (3, None)], "id int, t string")
    vocabulary = features.ngram_vocabulary(texts, "t", 3)
    assert [(r.term, r.n) for r in vocabulary.collect()] == [("nhà", 2), ("đẹp", 2), ("nhà đẹp", 1)]
    weights = {r.term: r.idf for r in features.term_weights(texts, "t", vocabulary).collect()}
    assert weights["đẹp"] == pytest.approx(math.log(4 / 3) + 1)
    entries = features.tfidf_entries(texts, "id", "t", features.term_weights(texts, "t", vocabulary)).collect()
    norms = {}
    for r in entries:
        norms[r.id] = norms.get(r.id, 0) + r.value**2
    assert norms == {1: pytest.approx(1), 2: pytest.approx(1)}


def test_regression_metrics_and_ranges(spark):
    pairs = [(100.0, 110.0), (200.0, 150.0), (400.0, 400.0)]
    row = regression_metrics(spark.createDataFrame(pairs, "a double, p double"), F.col("a"), F.col("p")).first()
    actual, predicted = np.array(pairs).T
    assert row.mae_vnd == pytest.approx(20)
    assert row.rmse_vnd == pytest.approx(math.sqrt(np.mean((actual - predicted) ** 2)))
    assert row.r2 == pytest.approx(1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum())
    assert row.within_20_pct == pytest.approx(200 / 3)
    one = regression_metrics(spark.createDataFrame(pairs[:1], "a double, p double"), F.col("a"), F.col("p")).first()
    assert one.r2 == 0.0
    price = spark.range(1).select(prediction_range(F.lit(2_345_678_901.0)).alias("r")).first().r
    assert (price.rounded, price.anomaly) == (2_346e6, False)
    versions = [("m", "1", 0.80, 4e8), ("m", "2", 0.74, 4e8), ("m", "3", 0.60, 4e8), ("m", "4", 0.78, 4e8)]
    gated = model_gate(spark.createDataFrame(versions, "model string, version string, r2 double, mae_vnd double"))
    assert [(r.verdict, r.rollback) for r in gated.orderBy("version").collect()] == [
        ("ACCEPT", False), ("WARN", True), ("REJECT", True), ("ACCEPT", False),
    ]
    more = [("m", "1", 0.80, 4e8, 7e8, 6000), ("m", "2", 0.805, 4e8, 7e8, 6000), ("m", "3", 0.82, 4e8, 7e8, 2000), ("m", "4", 0.9, 4e8, 9e8, None)]
    gated = model_gate(spark.createDataFrame(more, "model string, version string, r2 double, mae_vnd double, rmse_vnd double, sample_count int"))
    assert [r.verdict for r in gated.orderBy("version").collect()] == ["ACCEPT", "WARN", "REJECT", "WARN"]


def test_error_families(spark):
    codes = spark.createDataFrame([(1,), (99,), (100,), (450,), (1199,), (1200,)], "code bigint")
    families = spark.createDataFrame([(1, 99, "x"), (401, 499, "y"), (1101, 1199, "z")], "first bigint, last bigint, family string")
    got = {r.code: r.family for r in monitor.families_of(codes, "code", families).collect()}
    assert got == {1: "x", 99: "x", 100: None, 450: "y", 1199: "z", 1200: None}


def test_null_series_is_kept(spark):
    df = spark.createDataFrame([(None, float(t), t != 150) for t in range(0, 300, 10)], "name string, ts double, c boolean")
    got = timeline.held_since(df, ["name"], F.col("c"), chunk=100).orderBy("ts").collect()
    assert [r.since for r in got] == [0.0 if t < 150 else None if t == 150 else 160.0 for t in range(0, 300, 10)]


def test_families_of_two_ranges_in_one_hundred(spark):
    from gablework.operators import monitor

    families = spark.createDataFrame([(1, 49, "a"), (50, 99, "b"), (150, 320, "c")], "first long, last long, family string")
    codes = spark.createDataFrame([(10,), (60,), (100,), (301,), (None,)], "code long")
    got = {r.code: r.family for r in monitor.families_of(codes, "code", families).collect()}
    assert got == {10: "a", 60: "b", 100: None, 301: "c", None: None}


def test_rows_without_a_key_are_split_too(spark):
    from gablework.operators.split import mark_test

    keys = [(f"u{i}",) for i in range(16)] + [(None,)] * 4
    marked = mark_test(spark.createDataFrame(keys, "url string"), F.col("url"))
    assert marked.count() == 20 and marked.where("is_test").count() >= 4
