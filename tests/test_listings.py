import json
import time

import pytest
from pyspark.sql import functions as F

from gablework import fixed
from gablework.functions.text import clean_text
from gablework.operators import routing, upsert
from gablework.operators.normalize import NORMALIZED_COLUMNS, normalize, validate
from gablework.plans import queries
from gablework.plans.jobs import export_dataset, normalize_file, write_report
from gablework.sources import tables
from gablework.streaming import ingest

def now():
    return F.lit("2024-01-01T00:00:00+00:00")


def messages(spark, values):
    rows = [(None, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), "raw", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset bigint")


def test_normalize(spark):
    df = spark.createDataFrame([("abc", "100", "2 tỷ", "test")], "url string, area_text string, price_text string, title string")
    row = normalize(df, now()).first()
    assert (row.url, row.area_m2, row.price_vnd, row.price_per_m2_vnd) == ("abc", 100.0, 2e9, 2e7)
    assert row.source == "batdongsan_verified" and row.verified == 0 and row.text_features == "test"
    assert row.feature_coverage_score == 2 and row.has_target_price and not row.is_model_candidate
    assert row.updated_at == row.scraped_at == "2024-01-01T00:00:00+00:00"
    assert len(NORMALIZED_COLUMNS) == 38


def test_validate(spark):
    schema = "url string, price_vnd double, area_m2 double, price_per_m2_vnd double"
    rows = [
        ("abc", 2e9, 100.0, 2e7),
        (None, -1.0, 0.0, 0.0),
        ("", 501e9, 10001.0, None),
        ("a", 2e9, 100.0, 3e7),
        ("a", 2e9, 0.0, 3e7),
        ("a", None, None, None),
    ]
    got = [r.validation_errors for r in validate(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        [],
        ["missing_url", "price_non_positive", "area_non_positive"],
        ["missing_url", "price_too_large", "area_too_large"],
        ["price_per_m2_inconsistent"],
        ["area_non_positive"],
        [],
    ]


def test_json_types_decide_parsing(spark):
    values = [
        {"url": "u", "area_text": 1.234, "bedroom_text": 2.5, "verified": True},
        {"url": "u", "area_text": "1.234", "bedroom_text": True, "verified": "1", "road_width_text": -5},
        {"url": "u", "area_text": None, "verified": "", "road_width_text": "-5"},
    ]
    checked, dead = routing.route(messages(spark, values), now())
    rows = checked.orderBy("offset").collect()
    assert [r.area_m2 for r in rows] == [1.234, 1234.0, None]
    assert [r.bedroom_count for r in rows] == [2, 1, None]
    assert [r.verified for r in rows] == [1, 1, 0]
    assert [r.road_width_m for r in rows] == [None, -5.0, 5.0]
    assert [r.raw_area_text for r in rows] == ["1.234", "1.234", None]
    assert dead.count() == 0


def test_dead_letters(spark):
    values = ['{"url":', "[1, 2]", '"x"', "12", {"url": "u", "verified": "yes"}, {"url": "u", "verified": "1.5"}, {"url": "u"}]
    decoded = routing.decode(messages(spark, values))
    assert [r.error for r in decoded.orderBy("offset").collect()] == [
        "invalid_json", "not_an_object", "not_an_object", "not_an_object",
        "verified_not_an_integer", "verified_not_an_integer", None,
    ]
    dead = routing.dead_letters(decoded.where("error is not null")).orderBy("offset").collect()
    assert [d.kind for d in dead] == ["raw"] * 4 + ["payload"] * 2
    assert bytes(dead[0].raw) == b'{"url":'


def test_routed_in_one_pass(spark):
    values = [{"url": "u", "price_text": "2 tỷ"}, {"url": None}, '{"url":', {"url": "u", "verified": "yes", "area_text": "5"}]
    rows = routing.routed(messages(spark, values), now()).orderBy("offset").collect()
    assert [r.branch for r in rows] == ["feature", "invalid", "dead", "dead"]
    assert rows[0].price_vnd == 2e9 and rows[1].validation_errors == ["missing_url"]
    assert rows[3].url is None and rows[3].area_m2 is None and rows[3].error == "verified_not_an_integer"


def test_failed_writes(spark):
    checked, _ = routing.route(messages(spark, [{"url": "u"}]), now())
    row = routing.failed_writes(checked, F.lit("disk full"), normalized=True).first()
    assert (row.kind, row.error, row.offset) == ("normalized", "disk full", 0)
    assert json.loads(row.normalized)["url"] == "u" and row.payload is None


def test_branches(spark):
    rows = [("u", 1, []), ("u", 2, ["x"]), ("v", 1, ["x"]), ("v", 2, []), ("w", 1, [])]
    df = spark.createDataFrame(rows, "url string, offset int, validation_errors array<string>").withColumn("seen", F.col("offset"))
    stored = upsert.latest_branches(df, ["url"], ["offset"])
    valid = {r.url: r.seen for r in upsert.branch(stored, ["url"], "valid").collect()}
    invalid = {r.url: r.seen for r in upsert.branch(stored, ["url"], "invalid").collect()}
    assert valid == {"u": 1, "v": 2, "w": 1} and invalid == {"u": 2, "v": 1}
    both = upsert.in_both(upsert.branch(stored, ["url"], "valid"), upsert.branch(stored, ["url"], "invalid"))
    assert sorted(r.url for r in both.collect()) == ["u", "v"]


def test_search_text_is_joined_after_the_upsert(spark, tmp_path):
    """It equals the text of the winning version, and the upsert does not send it beside its parts."""
    days = ["2001-01-01 00:00:00", "2001-01-02 00:00:00"]
    made = [f"({u}L, {p}L, {s}L, {n}, 30.0D, 1.5D, 0.0D, 0.0D, 'N', 'O', timestamp_ntz'{days[n % 2]}')" for u in range(90, 110) for n, p, s in ((1, u, u + 1), (2, u + 4, u + 2))]
    names = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    spark.sql(f"SELECT * FROM VALUES {', '.join(made)} AS t({names})").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = queries.current_features(spark, str(tmp_path))
    checked = queries.validated(spark, str(tmp_path)).where(F.size("validation_errors") == 0)
    plain = upsert.latest_by_key(checked, ["url"], queries.ARRIVAL).select(*found.columns)
    assert found.columns[0] == "url" and "text_features" in found.columns
    assert found.count() == plain.count() > 5
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    sent = queries.branches
    seen = []
    try:
        queries.branches = lambda s, d, columns=None, only=None: seen.append(columns) or sent(s, d, columns, only)
        queries.current_features(spark, str(tmp_path))
        queries.current_invalid(spark, str(tmp_path))
    finally:
        queries.branches = sent
    assert len(seen) == 2 and all(columns and "text_features" not in columns for columns in seen)


def test_latest_and_merge(spark):
    rows = [("u", 1, "a", None), ("u", 3, None, "y"), ("u", 2, "b", "x"), (None, 1, "n", None), (None, 2, "m", None)]
    df = spark.createDataFrame(rows, "url string, offset int, p string, q string")
    got = {r.url: (r.p, r.q) for r in upsert.latest_by_key(df, ["url"], ["offset"]).collect()}
    assert got == {"u": (None, "y"), None: ("m", None)}
    logs = [("u", 1, '{"a":"1","b":"2"}'), ("u", 2, '{"b":null}'), ("u", 3, '{"c":"3"}')]
    merged = upsert.merge_fields(
        spark.createDataFrame(logs, "url string, offset int, v string"), "url", F.from_json("v", "map<string,string>"), F.col("offset")
    )
    assert {r.field: r.value for r in merged.collect()} == {"a": "1", "b": None, "c": "3"}
    wide = upsert.wide_fields(merged, "url", ["a", "b", "c", "d"]).first()
    assert (wide.a, wide.b, wide.c, wide.d) == ("1", None, "3", None)


STREAM = [
    {"url": "a", "price_text": "2 tỷ", "area_text": "100", "title": "first"},
    {"url": "b", "price_text": "700 tỷ", "area_text": "100"},
    '{"broken',
    {"url": "a", "price_text": "3 tỷ", "area_text": "100"},
    {"url": "b", "price_text": "5 tỷ", "area_text": "50"},
    {"url": "a", "price_text": "900 tỷ", "area_text": "100"},
]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    all_messages = messages(spark, STREAM).withColumn("timestamp", F.current_timestamp())
    for part in range(3):
        all_messages.where(f"offset % 3 = {part}").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(all_messages.schema).option("maxFilesPerTrigger", 1).json(source)
    query = ingest.start_ingest(stream, base, str(tmp_path / "checkpoint"), now())
    query.awaitTermination()
    checked, dead = routing.route(messages(spark, STREAM), now())
    ok = F.size("validation_errors") == 0
    expected = upsert.latest_by_key(checked.where(ok).drop("validation_errors", "topic"), ["url"], ["offset", "partition"])
    got = ingest.stored(spark, base, "training_features").select(*expected.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    rejected = {r.url: r.validation_errors for r in ingest.stored(spark, base, "invalid_records").collect()}
    assert rejected == {"a": ["price_too_large"], "b": ["price_too_large"]}
    assert ingest.log(spark, base, "dlq_raw").count() == dead.count() == 1
    assert ingest.offsets(spark, base).first().committed_offset == 6
    fields = {(r.url, r.field): r.value for r in ingest.stored_raw_fields(spark, base).collect()}
    assert fields[("a", "title")] == "first" and fields[("a", "price_text")] == "900 tỷ"
    # A replayed batch replaces itself.
    before = ingest.log(spark, base, "training_features").count()
    batch = messages(spark, STREAM).where("offset % 3 = 0")
    numbers = [int(p.name.split("=")[1]) for p in (tmp_path / "out" / "training_features").glob("batch=*")]
    files = {n: spark.read.parquet(f"{base}/listings_raw/batch={n}").first() for n in numbers}
    match = next(n for n, row in files.items() if row and row.offset % 3 == 0)
    ingest.store_batch(batch, match, base, now())
    assert ingest.log(spark, base, "training_features").count() == before
    ingest.compact(spark, base, "training_features", str(tmp_path / "table"))
    table = str(tmp_path / "table")
    assert ingest.stored(spark, base, "training_features", table).count() == 2
    # Newer batches come on top of the snapshot, and one that a crash has cut short is not read.
    newest = ingest.newest_snapshot(spark, table)
    late = [{"url": "a", "price_text": "4 tỷ", "area_text": "100", "title": "late"}, {"url": "c", "price_text": "1 tỷ", "area_text": "50"}]
    later = messages(spark, late).withColumn("offset", F.col("offset") + 100).withColumn("timestamp", F.current_timestamp())
    ingest.store_batch(later, newest + 1, base, now())
    (tmp_path / "table" / f"upto={newest + 9}").mkdir()
    for _ in range(2):
        rows = {r.url: r.title for r in ingest.stored(spark, base, "training_features", table).collect()}
        assert set(rows) == {"a", "b", "c"} and rows["a"] == "late"
        assert ingest.compact(spark, base, "training_features", table).endswith(f"upto={newest + 1}")
    assert ingest.newest_snapshot(spark, table) == newest + 1
    assert ingest.default_checkpoint(spark, base) != ingest.default_checkpoint(spark, base + "2")


def test_writes_are_accounted_and_refused_rows_become_dead_letters(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    ingest.store_batch(messages(spark, STREAM), 0, base, now())
    # The second batch's features meet a store that is gone.
    real = ingest._append

    def refusing(df, target, log, batch):
        if (log, batch) == ("training_features", 1):
            raise OSError("the store is gone")
        real(df, target, log, batch)

    monkeypatch.setattr(ingest, "_append", refusing)
    later = [{"url": "a", "price_text": "4 tỷ", "area_text": "100"}, {"url": "c", "price_text": "700 tỷ", "area_text": "50"}]
    ingest.store_batch(messages(spark, later), 1, base, now())
    account = {(r.batch, r.log): r for r in ingest.log(spark, base, "write_account", keep_batch=True).collect()}
    assert account[0, "training_features"].rows == 3 and account[0, "training_features"].error is None
    assert account[1, "training_features"].rows == 1 and account[1, "training_features"].error == "OSError: the store is gone"
    assert account[1, "invalid_records"].rows == 1 and account[1, "dlq_raw"].rows == 1
    letter = spark.read.parquet(f"{base}/dlq_raw/batch=1").first()
    assert letter.kind == "normalized" and json.loads(letter.normalized)["price_vnd"] == 4e9 and letter.offset == 0
    totals = {r.name: r.value for r in ingest.write_totals(spark, base).collect()}
    assert totals[fixed.WRITES_OK] == 5 + 3 + 2 + 2 + 1 and totals[fixed.WRITES_FAILED] == 1
    assert totals[fixed.DURATION_COUNT] == 2 and totals[fixed.DURATION_SUM] > 0
    # The batch again, with the store back: nothing is counted twice.
    monkeypatch.setattr(ingest, "_append", real)
    ingest.store_batch(messages(spark, later), 1, base, now())
    totals = {r.name: r.value for r in ingest.write_totals(spark, base).collect()}
    assert totals[fixed.WRITES_OK] == 5 + 3 + 2 + 2 + 1 + 1 and totals[fixed.WRITES_FAILED] == 0
    assert spark.read.parquet(f"{base}/dlq_raw/batch=1").count() == 0


def test_listener_counts_what_the_stream_consumed(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = messages(spark, STREAM).withColumn("timestamp", F.current_timestamp())
    rows.repartition(2).write.json(source)
    counters = ingest.IngestCounters()
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source)
        ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), now()).awaitTermination()
        until = time.time() + 20
        while counters.consumed < len(STREAM) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert (counters.consumed, counters.last_offset, counters.failure) == (6, 5, None)
    assert counters.batches == 2 and counters.seconds > 0


def test_files(spark, tmp_path):
    path = tmp_path / "records.json"
    records = [
        {"url": "a", "price_text": "2 tỷ", "area_text": 90.5, "property_type": "house", "province_slug": "x",
         "district_slug": "y", "title": "Nhà đẹp", "verified": 1},
        {"url": "b", "price_text": None, "area_text": "1.234"},
    ]
    path.write_text(json.dumps(records, ensure_ascii=False), encoding="utf-8")
    rows = normalize_file(spark, str(path), str(tmp_path / "normal"), now())
    assert {r.url: r.area_m2 for r in rows.collect()} == {"a": 90.5, "b": 1234.0}
    assert "price_vnd" in spark.read.json(str(tmp_path / "normal")).columns
    for kind in ["parquet", "csv", "jsonl"]:
        export_dataset(rows, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().title == "Nhà đẹp"
    assert "Nhà đẹp" in spark.read.text(str(tmp_path / "jsonl")).first().value
    with pytest.raises(ValueError):
        export_dataset(rows, str(tmp_path / "x"), "xlsx")
    write_report(rows, str(tmp_path / "report"))
    report = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert report["total_records"] == 2 and report["candidate_ratio"] == 0.5
    assert report["property_type_distribution"] == [{"_id": None, "count": 1}, {"_id": "house", "count": 1}]


def unfused(df):
    """The lines of a plan that compute columns without being part of a generated stage."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in lines if "Project [" in line and "*(" not in line]


def test_projection_of_many_texts_is_not_one_method(spark):
    texts = spark.range(3).selectExpr("cast(id as string) as a", "concat(' ', id, '\t b ') as b", "' ' as c", "cast(null as string) as d")
    cleaned = texts.select(*[clean_text(F.col(c)).alias(c) for c in texts.columns])
    assert unfused(cleaned)
    assert [tuple(r) for r in cleaned.orderBy("a").collect()] == [(str(i), f"{i} b", None, None) for i in range(3)]


def lineitem_rows(spark, folder, rows):
    """One file of one row group, as the given tables are."""
    columns = [f"cast({c} as bigint) as {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    made = rows.selectExpr(
        *columns, "cast(l_quantity as double) as l_quantity", "cast(l_linenumber as int) as l_linenumber",
        "timestamp'1995-01-02 00:00:00' as l_shipdate", "cast(l_partkey as double) as l_extendedprice",
    )
    made.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_raw_listings_of_one_file_are_read_by_all_cores(spark, tmp_path):
    # Two thirds of the rows are of one order, and some have no order.
    rows = spark.range(3000).selectExpr(
        "case when id % 3 > 0 then 7 when id % 30 = 0 then null else id end as l_orderkey", "id as l_partkey", "id % 10 as l_suppkey",
        "1 + id % 50 as l_quantity", "1 + id % 7 as l_linenumber",
    )
    d = lineitem_rows(spark, tmp_path, rows)
    found = tables.raw_listings(spark, d)
    assert unfused(found)
    tasks = 2 * spark.sparkContext.defaultParallelism
    held = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == tasks and max(r["count"] for r in held) < 1500
    plain = tables.read(spark, d, "lineitem").selectExpr(*tables.raw_select(tables.LINEITEM_SEEDS), *tables.LINEITEM_ARRIVAL)
    assert found.columns == plain.columns and found.count() == 3000
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0


def test_rows_in_enough_pieces_stay_where_they_are(spark):
    rows = spark.range(0, 100, 1, 2 * spark.sparkContext.defaultParallelism)
    assert tables.spread(rows, "id") is rows
