import uuid

import pytest
from pyspark.sql import functions as F

from gablework.operators.upsert import latest_by_key
from gablework.sources.keyed_log import KeyedLog, find_url, scan_priced, scan_trainable, write_features

SCHEMA = "url string, offset long, price_vnd double, valid boolean, description string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def log(spark, tmp_path):
    name = f"log_{uuid.uuid4().hex}"
    yield KeyedLog(spark, name, buckets=4, path=str(tmp_path / "log"))
    spark.sql(f"drop table if exists {name}")


def batch(spark, start, count):
    """Versions of a hot url, of others and of none; some are invalid."""
    n = F.col("id")
    url = F.when(n % 3 == 0, "hot").when(n % 17 == 1, None).otherwise(F.concat(F.lit("u"), (n % 23).cast("string")))
    return spark.range(start, start + count).select(
        url.alias("url"), n.alias("offset"), (n * 10.0).alias("price_vnd"), (n % 5 != 0).alias("valid"), F.concat(F.lit("text "), n.cast("string")).alias("description")
    )


def test_latest_versions_equal_the_upsert(spark, log):
    for k in range(3):
        log.append(batch(spark, 100 * k, 100), k)
    log.append(batch(spark, 100, 100), 1)  # a replay
    whole = batch(spark, 0, 300)
    assert log.versions().count() == 300
    columns = ["url", "price_vnd", "description"]
    expected = rows_of(latest_by_key(whole, ["url"], ["offset"]), *columns)
    assert rows_of(log.latest(["price_vnd", "description"]), *columns) == expected
    valid = rows_of(latest_by_key(whole.where("valid"), ["url"], ["offset"]), *columns)
    assert rows_of(log.latest(["price_vnd", "description"], F.col("valid")), *columns) == valid
    # A filter chooses among the winners, it does not make winners of older versions.
    dear = [r for r in valid if r[1] > 2900]
    assert dear and rows_of(log.latest(["price_vnd", "description"], F.col("valid"), F.col("price_vnd") > 2900), *columns) == dear


def test_several_position_columns(spark, log):
    log.position = ("price_vnd", "offset")
    log.append(batch(spark, 0, 90), 0)
    expected = rows_of(latest_by_key(batch(spark, 0, 90), ["url"], ["price_vnd", "offset"]), "url", "description")
    assert rows_of(log.latest(["description"]), "url", "description") == expected


def test_winners_and_their_rows_need_no_shuffle(spark, log):
    log.append(batch(spark, 0, 200), 0)
    log.append(batch(spark, 200, 200), 1)
    plan = plan_of(log.latest(["price_vnd"], F.col("valid")))
    keyed, unnamed = plan.split("_last", 1)
    assert "Exchange" not in keyed and "ShuffledHashJoin" in keyed and "Bucketed: true" in keyed
    assert "SortAggregate" not in keyed  # one position column: hashed, not sorted
    assert "Exchange hashpartitioning" not in unnamed and "description" not in plan


def test_scans_of_the_stored_table_push_filters_and_prune(spark, tmp_path):
    path = str(tmp_path / "features")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    n = F.col("id")
    features = spark.range(1000).select(
        F.concat(F.lit("u"), n).alias("url"), F.when(n % 4 > 0, n * 1e6).alias("price_vnd"), (n % 3 == 0).alias("is_model_candidate"),
        (n % 4 > 0).alias("has_target_price"), F.concat(F.lit("p"), n % 7).alias("province_slug"), (n * 0.5).alias("area_m2"), F.repeat(F.lit("long text "), 20).alias("description"),
    )
    write_features(features, path, parts=4)
    priced, trainable = scan_priced(spark, path, "area_m2"), scan_trainable(spark, path, "area_m2")
    assert priced.count() == features.where("price_vnd > 0").count()
    assert rows_of(trainable, "url") == rows_of(features.where("is_model_candidate and price_vnd > 0"), "url")
    for df, filters in ((priced, ["GreaterThan(price_vnd,0.0)"]), (trainable, ["EqualTo(is_model_candidate,true)", "GreaterThan(price_vnd,0.0)"])):
        plan = plan_of(df)
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        schema = plan.split("ReadSchema: ")[1].splitlines()[0]
        assert all(f in pushed for f in filters), pushed
        assert "description" not in schema and "province_slug" not in schema
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert find_url(spark, path, "u77").first().area_m2 == 38.5 and find_url(spark, path, "none").count() == 0
