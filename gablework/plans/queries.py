"""Registered queries: every operator run over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import (
    clean_text,
    location_parts,
    pair_map,
    parse_int,
    parse_number,
    parse_price,
    property_type_from_url,
    text_features,
    train_text,
)
from ..functions.listing import TEXT_PARTS
from ..operators import evaluate, extract, features, monitor, order_stats, quality, routing, upsert
from ..operators import split as splitting
from ..operators.normalize import NORMALIZED_COLUMNS, normalize, validate
from ..session import cut_lineage
from ..sources import tables
from . import training

NOW = "2001-12-01T00:00:00+00:00"
COUNTS = ["bedroom_count", "bathroom_count", "floor_count"]
ARRIVAL = tables.LINEITEM_ARRIVAL
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# What a checked listing has beside its url.
CHECKED_COLUMNS = [*NORMALIZED_COLUMNS[1:], "validation_errors"]

# What the quality reports read of a listing.
REPORTED = ["property_type", "province_slug", "is_model_candidate", "price_vnd"]

# Selectors that fit the given pages, which have no listing cards or specification tables.
NAV_LINKS = {"container": "nav", "cards": ["li"], "link": "a"}
PAGE_PARTS = {
    "title": ["h1"],
    "short_titles": ["nav", "a"],
    "short_values": ["article", "*"],
    "spec_titles": ["article", "h1"],
    "spec_values": ["article", "p"],
    "body": ["article", "*"],
    "breadcrumb": ["nav", "*"],
}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def raw(spark: SparkSession, d: str) -> DataFrame:
    return tables.raw_listings(spark, d)


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every listing, normalised, with its arrival order."""
    return normalize(raw(spark, d), F.col("processed_at"), keep=ARRIVAL)


def validated(spark: SparkSession, d: str) -> DataFrame:
    return validate(listings(spark, d))


def branches(spark: SparkSession, d: str, columns: list[str] | None = None, only: str | None = None) -> DataFrame:
    return upsert.latest_branches(validated(spark, d), ["url"], ARRIVAL, columns, only)


def current_rows(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    """One branch with these columns. The search text repeats other columns, so the upsert takes its parts and they are
    joined for the winners only."""
    rejoined = fixed.TEXT_FEATURE in columns
    sent = [c for c in columns if c != fixed.TEXT_FEATURE]
    rows = upsert.branch(branches(spark, d, [*sent, *TEXT_PARTS] if rejoined else sent, name), ["url"], name)
    if rejoined:
        rows = rows.withColumn(fixed.TEXT_FEATURE, text_features(cleaned=True))
    return rows.select("url", *[c for c in CHECKED_COLUMNS if c in columns and c in rows.columns])


def current_features(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The stored feature table: last valid version per url, with these columns or all."""
    return current_rows(spark, d, "valid", list(columns or CHECKED_COLUMNS))


def current_invalid(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(spark, d, "invalid", CHECKED_COLUMNS)


def trainable(df: DataFrame) -> DataFrame:
    """Priced candidates; a missing flag or flag column counts as a candidate."""
    flag = F.coalesce(F.col("is_model_candidate"), F.lit(True)) if "is_model_candidate" in df.columns else F.lit(True)
    return df.where(flag & (F.col(fixed.TARGET) > 0))


def training_table(spark: SparkSession, d: str) -> DataFrame:
    """Priced candidates of the stored feature table, keyed by url, materialised for the passes over it."""
    columns = [*fixed.NUMERIC_FEATURES, *fixed.CATEGORICAL_FEATURES, fixed.TEXT_FEATURE, fixed.TARGET]
    return cut_lineage(trainable(current_features(spark, d, "is_model_candidate", *columns)).select("url", *columns))


def counts_as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable counts as DOUBLE, which every engine and client prints alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns or COUNTS})


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# Scans, exports and envelopes


@query
def scan_priced(spark, d):
    rows = current_features(spark, d, "price_vnd", "area_m2", "updated_at")
    return rows.where(F.col("price_vnd") > 0).select("url", "price_vnd", "area_m2", "updated_at")


@query
def scan_trainable(spark, d):
    columns = ["price_vnd", "area_m2", "property_type"]
    return trainable(current_features(spark, d, "is_model_candidate", *columns)).select("url", *columns)


@query
def export_candidates(spark, d):
    return counts_as_double(current_features(spark, d).where("is_model_candidate").select(*NORMALIZED_COLUMNS))


# The columns of the raw sample, in file order.
SAMPLE_COLUMNS = [
    "url",
    "listing_id",
    "title",
    "price_text",
    "area_text",
    "bedroom_text",
    "bathroom_text",
    "floor_text",
    "front_width_text",
    "road_width_text",
    "legal_text",
    "direction_text",
    "property_type",
    "listing_type",
    "posted_date_text",
    "furniture_text",
    "project_hint",
    "description",
    "verified",
    "location_slug",
    "province_slug",
    "district_slug",
    "ward_slug",
    "scraped_at",
]


@query
def raw_sample_projection(spark, d):
    return raw(spark, d).orderBy(*ARRIVAL).limit(10).select(*SAMPLE_COLUMNS)


@query
def raw_envelope(spark, d):
    return routing.raw_envelope(raw(spark, d))


@query
def feature_envelope(spark, d):
    return routing.feature_envelope(validated(spark, d))


@query
def quality_report_json(spark, d):
    return quality.report(current_features(spark, d, *REPORTED))


@query
def feature_envelope_fields(spark, d):
    """The audit messages read back, field by field."""
    fields = "url string, property_type string, price_vnd double, area_m2 double, is_model_candidate boolean, validation_errors array<string>"
    read = feature_envelope(spark, d).select("key", F.from_json("value", fields).alias("v"))
    errors = F.coalesce(joined("v.validation_errors"), F.lit("")).alias("errors")
    return read.select("key", "v.url", "v.property_type", "v.price_vnd", "v.area_m2", "v.is_model_candidate", errors)


@query
def quality_report_fields(spark, d):
    """The report read back: totals and both lists as rows (section, pos, id, count)."""
    pairs = "array<struct<_id string, count bigint>>"
    totals = ["total_records", "model_candidates", "records_with_target_price"]
    fields = ", ".join([*[f"{c} bigint" for c in totals], f"property_type_distribution {pairs}", f"top_provinces {pairs}"])
    read = quality_report_json(spark, d).select(F.from_json("report", fields).alias("r")).select("r.*")
    named = F.array(*[F.struct(F.lit(c).alias("_id"), F.col(c).alias("count")) for c in totals])
    sections = F.array(
        *[
            F.struct(F.lit(name).alias("section"), entries.alias("entries"))
            for name, entries in {
                "totals": named,
                "property_types": F.col("property_type_distribution"),
                "top_provinces": F.col("top_provinces"),
            }.items()
        ]
    )
    rows = read.select(F.inline(sections)).select("section", F.posexplode("entries").alias("pos", "e"))
    return rows.select("section", "pos", F.col("e._id").alias("id"), F.col("e.count").alias("count"))


# Extraction from stored pages


@query
def page_links(spark, d):
    return extract.listing_links(tables.read(spark, d, "pages").select("page_id", "html"), NAV_LINKS)


@query
def page_texts(spark, d):
    pages = tables.read(spark, d, "pages").select("page_id", "html")
    parts = extract.page_parts(pages, {"body": ["article", "*"]})
    return parts.select("page_id", F.posexplode("body").alias("pos", "text"))


@query
def page_pairs(spark, d):
    pages = tables.read(spark, d, "pages").select("page_id", "html")
    parts = extract.page_parts(pages, {"titles": ["nav", "a"], "values": ["article", "*"]})
    return parts.select("page_id", F.explode(pair_map(F.col("titles"), F.col("values"))).alias("title", "value"))


@query
def detail_record(spark, d):
    pages = tables.read(spark, d, "pages").select("url", "html")
    return extract.detail_records(pages, F.lit(NOW), selectors=PAGE_PARTS)


@query
def property_type_from_url_query(spark, d):
    return raw(spark, d).select("url", property_type_from_url(F.col("url")).alias("type_from_url"))


@query
def location_from_url(spark, d):
    urls = raw(spark, d).select("url").unionByName(tables.read(spark, d, "pages").select("url")).distinct()
    return urls.select("url", location_parts(F.col("url")).alias("place")).select("url", "place.*")


@query
def page_frontier(spark, d):
    configs = tables.read(spark, d, "part").selectExpr(
        "p_partkey", "1 + p_partkey % 5 as start_page", "cast(p_size % 7 as bigint) as max_pages",
        "case when p_partkey % 3 = 0 then null else p_partkey % 9 end as next_page",
    )
    return extract.page_frontier(configs).select("p_partkey", "page", "list_url")


@query
def unseen_pages(spark, d):
    links = raw(spark, d).select(F.col("url").alias("link")).where("link is not null")
    seen = tables.read(spark, d, "orders").selectExpr(f"{tables.URL.format(u='o_custkey')} as link")
    return extract.unseen(links, seen)


# Scalar functions


@query
def clean_text_query(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query
def parse_number_query(spark, d):
    return raw(spark, d).select(
        "area_text", "front_width_text",
        parse_number(F.col("area_text")).alias("area"), parse_number(F.col("front_width_text")).alias("front_width"),
    )


@query
def parse_int_query(spark, d):
    return raw(spark, d).select(
        "bedroom_text", "floor_text",
        parse_int(F.col("bedroom_text")).cast("double").alias("bedrooms"),
        parse_int(F.col("floor_text")).cast("double").alias("floors"),
    )


@query
def parse_price_query(spark, d):
    priced = raw(spark, d).select("price_text", "area_text", parse_number(F.col("area_text")).alias("area"))
    parsed = priced.withColumn("price", parse_price(F.col("price_text"), F.col("area")))
    return parsed.select("price_text", "area", F.col("price.total").alias("total_vnd"), F.col("price.per_m2").alias("per_m2_vnd"))


@query
def text_features_query(spark, d):
    renamed = raw(spark, d).withColumnsRenamed(
        {"furniture_text": "furniture", "legal_text": "legal", "direction_text": "direction"}
    )
    return renamed.select("url", text_features().alias("text_features"))


@query
def train_text_query(spark, d):
    """Training text where only candidates have a stored text and the others fall back to their parts."""
    stored = listings(spark, d).withColumn("stored", F.when(F.col("is_model_candidate"), F.col("text_features")))
    return stored.select("url", "l_linenumber", train_text(F.col("stored")).alias("train_text"))


@query
def coverage_score_query(spark, d):
    return listings(spark, d).select("url", "updated_at", "feature_coverage_score")


@query
def model_candidates(spark, d):
    return listings(spark, d).where("is_model_candidate").select("url", "price_vnd", "area_m2", "feature_coverage_score")


@query
def normalize_listings(spark, d):
    return counts_as_double(listings(spark, d).select(*NORMALIZED_COLUMNS))


# Validation and routing


@query
def validate_listings(spark, d):
    return validated(spark, d).select(
        "url", "price_vnd", "area_m2", "price_per_m2_vnd", joined("validation_errors"),
        (F.size("validation_errors") == 0).alias("is_valid"),
    )


def requests(spark, d):
    kept = ["property_type", "direction_text", "legal_text", "listing_type", "province_slug", "district_slug",
            "ward_slug", "project_hint", "title", "description"]
    lines = tables.read(spark, d, "lineitem")
    sources = dict(c.rsplit(" as ", 1)[::-1] for c in tables.raw_select(tables.LINEITEM_SEEDS))
    return lines.selectExpr(*tables.REQUEST_SELECT, *[f"{sources[c]} as {c}" for c in kept], *ARRIVAL)


@query
def validate_requests(spark, d):
    return requests(spark, d).select(
        "area_m2", "bedroom_count", "bathroom_count", F.col("floor_count").cast("double"), "front_width_m", "road_width_m",
        F.array_join(quality.request_errors(), ",").alias("errors"),
    )


@query
def request_error_codes(spark, d):
    return requests(spark, d).select(
        "area_m2", "bedroom_count", F.col("floor_count").cast("double"), "front_width_m", "property_type",
        F.array_join(quality.request_codes(), ",").alias("codes"),
    )


@query
def training_gate(spark, d):
    rows = current_features(spark, d, "is_model_candidate", "has_target_price").agg(
        F.count_if(F.col("is_model_candidate") & F.col("has_target_price")).alias("trainable_rows")
    )
    return rows.select(
        "trainable_rows",
        (F.col("trainable_rows") >= fixed.MIN_TRAIN_ROWS).alias("can_train"),
        (F.col("trainable_rows") >= fixed.MIN_SCHEDULED_TRAIN_ROWS).alias("schedule_training"),
    )


@query
def latest_features(spark, d):
    return counts_as_double(current_features(spark, d))


@query
def latest_invalid(spark, d):
    return counts_as_double(current_invalid(spark, d)).withColumn("validation_errors", F.array_join("validation_errors", ","))


@query
def stale_valid_urls(spark, d):
    both = branches(spark, d, ["updated_at"]).where("valid is not null and invalid is not null")
    return both.select("url", "valid.updated_at")


@query
def raw_field_merge(spark, d):
    decoded = routing.decode(tables.listing_messages(spark, d)).where("error is null")
    fields = F.from_json("value", "map<string,string>")
    return upsert.merge_fields(decoded, "key", fields, F.col("offset"))


@query
def route_messages(spark, d):
    rows = routing.routed(tables.listing_messages(spark, d), F.lit(NOW))
    shown = rows.select(
        *routing.POSITION, "url", "branch", "price_vnd", "area_m2", "bedroom_count", "road_width_m", "verified",
        joined("validation_errors"),
    )
    return counts_as_double(shown, "bedroom_count", "verified")


@query
def dead_letters(spark, d):
    dead = routing.dead_letters(routing.decode(tables.listing_messages(spark, d)).where("error is not null"))
    return dead.withColumn("raw", F.col("raw").cast("string"))


@query
def offset_checkpoint(spark, d):
    return routing.offset_checkpoint(tables.event_messages(spark, d))


@query
def consumer_lag(spark, d):
    messages = tables.event_messages(spark, d)
    high = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("high"))
    done = routing.offset_checkpoint(routing.decode(messages).where("error is null"))
    return routing.consumer_lag(done.select("topic", "partition", "last_processed_offset"), high)


@query
def replay_dedup(spark, d):
    messages = tables.event_messages(spark, d)
    replayed = messages.unionByName(messages)
    return routing.replay_dedup(replayed).groupBy("topic", "partition").agg(
        F.count("*").alias("messages"), F.sum("offset").alias("offset_sum")
    )


@query
def message_counters(spark, d):
    return routing.message_counters(tables.listing_messages(spark, d), F.lit(NOW))


@query
def collection_counts(spark, d):
    keyed = validated(spark, d).select("url", (F.size("validation_errors") == 0).alias("valid"))
    per_url = keyed.groupBy("url").agg(F.bool_or("valid").alias("has_valid"), F.bool_or(~F.col("valid")).alias("has_invalid"))
    stored = per_url.agg(
        F.count("*").alias("listings_raw"),
        F.count_if("has_valid").alias("training_features"),
        F.count_if("has_invalid").alias("invalid_records"),
    ).unpivot([], ["listings_raw", "training_features", "invalid_records"], "collection", "rows")
    dead = routing.decode(tables.listing_messages(spark, d)).where("error is not null")
    return stored.unionByName(dead.agg(F.count("*").alias("rows")).withColumn("collection", F.lit("dlq_raw")))


# Quality report


@query
def quality_summary(spark, d):
    return quality.summary(current_features(spark, d, "is_model_candidate", "price_vnd"))


@query
def property_type_distribution(spark, d):
    return quality.group_counts(current_features(spark, d, "property_type"), "property_type")


@query
def top_provinces(spark, d):
    return quality.group_counts(current_features(spark, d, "province_slug"), "province_slug", 20)


@query
def feature_health(spark, d):
    """Day's totals, rows of the last hour, last update and number of property types."""
    now = "2001-06-01T08:00:00+00:00"
    recent = quality.newer_than(current_features(spark, d, "scraped_at", "updated_at", "property_type"), now, 1, "scraped_at")
    age = quality.epoch_seconds(F.lit(now)) - quality.epoch_seconds(F.col("updated_at"))
    last_hour = (age >= 0) & (age < 3600)
    return recent.agg(
        F.count("*").alias("total_records"),
        F.count_if(last_hour).alias("records_last_hour"),
        F.max("updated_at").alias("last_update"),
        F.countDistinct("property_type").alias("property_types_covered"),
    )


@query
def quality_24h(spark, d):
    rows = current_features(spark, d, "updated_at", "is_model_candidate", "feature_coverage_score")
    recent = quality.newer_than(rows, "2001-06-01T08:00:00+00:00", 1, "updated_at")
    counted = recent.agg(
        F.count("*").alias("total"),
        F.count_if("is_model_candidate").alias("candidates"),
        F.round(F.avg("feature_coverage_score"), 2).alias("avg_coverage"),
    )
    return counted.withColumn("candidate_ratio", F.round(quality.ratio(F.col("candidates") * 100.0, F.col("total")), 2))


@query
def log_error_rate(spark, d):
    logs = tables.read(spark, d, "events").where("ts > timestamp_ntz'2024-01-30 00:00:00'")
    counted = logs.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counted.withColumn("error_rate", F.round(quality.ratio(F.col("errors") * 100.0, F.col("total")), 2))


COMPLETENESS_LIMITS = {
    "price_vnd": 30.0,
    "area_m2": 30.0,
    "property_type": 10.0,
    "description": 50.0,
    "province_slug": 1.0,
    "raw_price_text": 10.0,
    "raw_area_text": 15.0,
}


@query
def field_completeness(spark, d):
    return quality.completeness(listings(spark, d), COMPLETENESS_LIMITS)


@query
def outlier_flags(spark, d):
    return quality.outlier_flags(listings(spark, d)).select(
        "url", "price_vnd", "area_m2", "price_per_m2_vnd", joined("outliers")
    )


@query
def quality_score(spark, d):
    return quality.quality_score(listings(spark, d), "2001-11-04T12:00:00+00:00")


@query
def duplicate_rate(spark, d):
    return quality.duplicate_rate(raw(spark, d).select("url"))


@query
def consistency_checks(spark, d):
    return quality.consistency(listings(spark, d))


@query
def freshness_tiers(spark, d):
    return quality.freshness_tiers(listings(spark, d), "2001-11-05T03:30:00+00:00")


@query
def gate_status(spark, d):
    """Gates in front of storing, normalising and training, each ACCEPT, WARN or REJECT."""
    counted = listings(spark, d).agg(
        F.count("*").alias("rows"),
        F.count("url").alias("with_url"),
        F.count_if("is_model_candidate").alias("candidates"),
        F.min("updated_at").alias("oldest"),
        F.count_if(quality.accurate()).alias("accurate"),
    )
    share = quality.ratio(F.col("candidates") * 100.0, F.col("rows"))
    filled = quality.ratio(F.col("with_url") * 100.0, F.col("rows"))
    age_days = (quality.epoch_seconds(F.lit(NOW)) - quality.epoch_seconds(F.col("oldest"))) / 86400
    accuracy = quality.ratio(F.col("accurate") * 100.0, F.col("rows"))
    gates = F.array(
        F.struct(F.lit("intake").alias("gate"), quality.gate((F.col("rows") > 200) & (filled >= 90), filled >= 85).alias("status")),
        F.struct(F.lit("normalised").alias("gate"), quality.gate((F.col("rows") > 150) & (share >= 60), share >= 50).alias("status")),
        F.struct(
            F.lit("training").alias("gate"),
            quality.gate(
                (F.col("candidates") >= 200) & (age_days <= 30), (F.col("candidates") >= 100) & (age_days <= 90)
            ).alias("status"),
        ),
        F.struct(F.lit("accuracy").alias("gate"), quality.gate(accuracy >= 95, accuracy >= 80).alias("status")),
    )
    return counted.select(F.explode(gates).alias("g")).select("g.gate", "g.status")


@query
def raw_schema_checks(spark, d):
    return quality.raw_schema_checks(raw(spark, d))


@query
def hourly_volume(spark, d):
    """Events per hour from the first to the last, hours without events included."""
    counts = tables.read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    counted = counts.agg(F.count("*").alias("rows"))
    ends = counted.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    hours = ends.select(F.explode(F.sequence("first", "last", F.expr("interval 1 hour"))).alias("hour"))
    volume = hours.join(counted, "hour", "left").fillna(0, ["rows"])
    hour = F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour")
    return volume.select(hour, "rows", (F.col("rows") >= 180).alias("on_target"), (F.col("rows") < 150).alias("warn"))


@query
def recent_training_rows(spark, d):
    rows = trainable(current_features(spark, d, "price_vnd", "is_model_candidate", "updated_at"))
    return quality.newer_than(rows, "2001-10-01T00:00:00+00:00", 30, "updated_at").select("url", "price_vnd", "updated_at")


RETENTION_DAYS = {"raw_topic": 7, "feature_topic": 30, "raw_archive": 90, "features": 365}


@query
def retention_filter(spark, d):
    """Rows every store still keeps, all stores counted in one pass."""
    age = (quality.epoch_seconds(F.lit("2001-10-01T00:00:00+00:00")) - quality.epoch_seconds(F.col("scraped_at"))) / 86400
    kept = [F.count_if(age <= limit).alias(name) for name, limit in RETENTION_DAYS.items()]
    return listings(spark, d).agg(*kept).unpivot([], list(RETENTION_DAYS), "store", "kept_rows")


@query
def feature_stats(spark, d):
    return listings(spark, d).groupBy("property_type", "province_slug").agg(
        F.count("*").alias("rows"),
        F.count_if("is_model_candidate").alias("candidates"),
        F.round(F.avg("price_vnd"), 0).alias("avg_price"),
        F.min("area_m2").alias("min_area"),
        F.max("area_m2").alias("max_area"),
    )


@query
def error_families(spark, d):
    codes = tables.read(spark, d, "events").selectExpr("event_id", "(event_id * 37) % 1300 as code")
    families = spark.createDataFrame(fixed.ERROR_FAMILIES, "first bigint, last bigint, family string")
    return monitor.families_of(codes, "code", families)


# Evaluation and model versions


def predictions(spark, d):
    return tables.read(spark, d, "orders").selectExpr(
        "o_orderkey", "o_totalprice as actual", "o_totalprice * (8e-1 + (o_orderkey % 41) / 1e2) as predicted"
    )


@query
def regression_metrics(spark, d):
    metrics = evaluate.regression_metrics(predictions(spark, d), F.col("actual"), F.col("predicted"))
    digits = {"r2": 8, "sample_count": 0}
    return metrics.select(*[F.round(c, digits.get(c, 4)).alias(c) for c in metrics.columns])


@query
def prediction_interval(spark, d):
    ranged = predictions(spark, d).selectExpr("o_orderkey", "predicted * 5e4 as price")
    return ranged.withColumn("range", evaluate.prediction_range(F.col("price"))).select(
        "o_orderkey", F.col("range.rounded").alias("rounded"), F.round("range.low", 2).alias("low"),
        F.round("range.high", 2).alias("high"), F.col("range.anomaly").alias("anomaly"),
    )


def versions(spark, d):
    return tables.read(spark, d, "part").selectExpr(
        "p_brand as model",
        "lpad(cast(p_partkey as string), 12, '0') as version",
        "6e-1 + ((p_partkey * 7) % 25) / 1e2 as r2",
        "3e8 + p_size * 1e7 as mae_vnd",
        "4e8 + p_size * 2e7 as rmse_vnd",
        "8e0 + (p_partkey * 3) % 14 as mape_pct",
        "cast(p_size * 200 as bigint) as sample_count",
    )


@query
def latest_model_metadata(spark, d):
    return evaluate.current_version(versions(spark, d))


@query
def model_gate(spark, d):
    gated = evaluate.model_gate(versions(spark, d))
    return gated.select("model", "version", F.round("r2", 6).alias("r2"), F.round("previous_r2", 6).alias("previous_r2"), "rollback", "verdict")


@query
def model_retention(spark, d):
    return evaluate.latest_versions(versions(spark, d), 3).select("model", "version")


@query
def district_options(spark, d):
    """Parent and child options of every customer, with the child chosen first for that parent."""
    nation = tables.read(spark, d, "nation")
    region = tables.read(spark, d, "region")
    first = nation.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("first_option"))
    options = nation.join(region, nation.n_regionkey == region.r_regionkey).join(first, "n_regionkey")
    customers = tables.read(spark, d, "customer")
    return customers.join(options, customers.c_nationkey == options.n_nationkey).select(
        "c_custkey", F.col("r_name").alias("province"), F.col("n_name").alias("district"), "first_option"
    )


@query
def train_test_split(spark, d):
    urls = training_table(spark, d).select("url")
    return splitting.mark_test(urls, F.col("url"))


@query
def train_test_sizes(spark, d):
    marked = train_test_split(spark, d)
    return marked.agg(F.count_if(~F.col("is_test")).alias("train_size"), F.count_if("is_test").alias("test_size"))


# Model inputs


@query
def impute_median(spark, d):
    rows = cut_lineage(listings(spark, d).select("url", "updated_at", *fixed.NUMERIC_FEATURES))
    middle = order_stats.medians(rows, fixed.NUMERIC_FEATURES)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in middle.items() if m is not None}
    return rows.select("url", "updated_at", *[column.alias(c) for c, column in filled.items()])


@query
def standardize(spark, d):
    rows = cut_lineage(listings(spark, d).select("url", *fixed.NUMERIC_FEATURES))
    stats = features.numeric_stats(rows, fixed.NUMERIC_FEATURES)
    return rows.select(
        "url", *[F.round(features.standardized(c, s), 6).alias(c) for c, s in stats.items() if s is not None]
    )


@query
def impute_mode(spark, d):
    rows = listings(spark, d)
    values = features.mode_values(features.category_counts(rows, fixed.CATEGORICAL_FEATURES))
    return features.fill_modes(rows, fixed.CATEGORICAL_FEATURES, values).select("url", *fixed.CATEGORICAL_FEATURES)


@query
def one_hot(spark, d):
    """Categories of all stored listings, encoded with the vocabulary of the model candidates."""
    columns = ["is_model_candidate", *fixed.CATEGORICAL_FEATURES]
    rows = cut_lineage(current_features(spark, d, *columns).select("url", *columns))
    vocabulary = features.category_counts(rows.where("is_model_candidate"), fixed.CATEGORICAL_FEATURES)
    return features.one_hot_entries(rows, "url", fixed.CATEGORICAL_FEATURES, vocabulary)


@query
def ngram_vocab(spark, d):
    return features.ngram_vocabulary(tables.read(spark, d, "documents"), "text")


@query
def tfidf_terms(spark, d):
    documents = tables.read(spark, d, "documents").select("doc_id", "text")
    weights = features.term_weights(documents, "text", features.ngram_vocabulary(documents, "text"))
    entries = features.tfidf_entries(documents, "doc_id", "text", weights)
    return entries.select("doc_id", "term", F.round("value", 6).alias("value"))


@query
def design_matrix(spark, d):
    """Design matrix of the training listings in coordinate form."""
    rows = training_table(spark, d)
    stats = features.numeric_stats(rows, fixed.NUMERIC_FEATURES)
    counts = features.category_counts(rows, fixed.CATEGORICAL_FEATURES)
    filled = features.fill_modes(rows, fixed.CATEGORICAL_FEATURES, features.mode_values(counts))
    weights = features.term_weights(rows, fixed.TEXT_FEATURE, features.ngram_vocabulary(rows, fixed.TEXT_FEATURE))
    entries = features.design_entries(filled, "url", stats, counts, weights)
    return entries.withColumn("value", F.round("value", 6))


SETTINGS = training.Settings()
_PREPARED: dict[tuple[str, str], tuple[DataFrame, training.Fit]] = {}


def prepared(spark, d) -> tuple[DataFrame, training.Fit]:
    """The marked candidates and their fit, made once per session and data set; each regression fits when it is asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PREPARED:
        marked = cut_lineage(training.split(training_table(spark, d), SETTINGS, "url"))
        _PREPARED[key] = marked, training.prepare(marked.where("not is_test").drop("is_test"), SETTINGS)
    return _PREPARED[key]


def whole_model(spark, d) -> training.PriceModel:
    fit = prepared(spark, d)[1]
    return training.PriceModel(fit.design, fit.ridge(), fit.boosted())


@query
def ridge_fit(spark, d):
    """For every design column its covariance with the log price, and what the optimality condition leaves of the
    ridge: the gradient of its objective over the largest that zero weights have. That is 0 at the optimum alone."""
    fit = prepared(spark, d)[1]
    ridge = fit.ridge()
    left = np.abs(ridge.gradient) / max(float(np.abs(ridge.start).max()), 1e-300)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ridge.start / ridge.rows, left))]
    both = fit.design.names().join(spark.createDataFrame(rows, "column int, covariance double, gradient double"), "column")
    return both.select("feature", *[(F.round(c, 6) + 0.0).alias(c) for c in ("covariance", "gradient")])


@query
def ridge_metrics(spark, d):
    """Metrics of the ridge in log space over the rows that the fit has not seen."""
    marked, fit = prepared(spark, d)
    scored = training.PriceModel(fit.design, ridge=fit.ridge()).transform(marked.where("is_test"))
    return evaluate.regression_metrics(scored, F.log1p(fixed.TARGET), F.col("ridge_log"))


@query
def gbt_fit(spark, d):
    """Metrics of the boosted trees in log space over the rows that the fit has not seen."""
    marked, fit = prepared(spark, d)
    scored = training.PriceModel(fit.design, boosted=fit.boosted()).transform(marked.where("is_test"))
    return evaluate.regression_metrics(scored, F.log1p(fixed.TARGET), F.col("boost_log"))


@query
def gbt_shape(spark, d):
    """Whether the trees keep to their limits: depth, leaves, rows in a leaf, and better than the mean price by squared
    error on the rows that they were fitted to."""
    marked, fit = prepared(spark, d)
    boosted = fit.boosted()
    scored = training.PriceModel(fit.design, boosted=boosted).transform(marked.where("not is_test"))
    log = F.log1p(fixed.TARGET)
    error = scored.agg(F.count("*").alias("rows"), F.avg((log - F.col("boost_log")) ** 2).alias("error"), F.var_pop(log).alias("spread")).first()
    rows = [
        ("fitted_rows", float(error.rows), True),
        ("rounds", float(SETTINGS.boost_rounds), 0 < len(boosted.trees) <= SETTINGS.boost_rounds),
        ("depth", float(SETTINGS.boost_depth), max(t.depth() for t in boosted.trees) <= SETTINGS.boost_depth),
        ("leaves", float(SETTINGS.boost_leaves), max(t.leaves for t in boosted.trees) <= SETTINGS.boost_leaves),
        ("leaf_rows", float(fixed.BOOST_LEAF_ROWS), min(boosted.leaf_rows) >= fixed.BOOST_LEAF_ROWS),
        ("below_mean_error", 1.0, error.error < error.spread),
    ]
    return spark.createDataFrame(rows, "measure string, value double, kept boolean")


@query
def ensemble_score(spark, d):
    marked, _ = prepared(spark, d)
    scored = whole_model(spark, d).transform(marked)
    return scored.select("url", "ridge_log", "boost_log", fixed.TARGET, "predicted_price_vnd")


@query
def ensemble_vote(spark, d):
    """Per candidate, how far its price is from the vote of its logged predictions: their mean, taken back from logs,
    and the same in billions to four places."""
    scored = whole_model(spark, d).transform(prepared(spark, d)[0])
    voted = F.exp((F.col("ridge_log") + F.col("boost_log")) / 2) - 1
    gap = F.round(F.abs(F.col("predicted_price_vnd") / voted - 1), 6)
    billions = F.col("predicted_price_billion_vnd") - F.col("predicted_price_vnd") / 1e9
    return scored.select("url", fixed.TARGET, gap.alias("gap"), (F.abs(billions) <= 0.0000501).alias("billions_right"))


@query
def scored_listings(spark, d):
    """Predictions for every stored listing, priced or not."""
    columns = [*fixed.NUMERIC_FEATURES, *fixed.CATEGORICAL_FEATURES, fixed.TEXT_FEATURE, fixed.TARGET]
    scored = whole_model(spark, d).transform(current_features(spark, d, *columns))
    return scored.select("url", "price_vnd", "predicted_price_vnd", "predicted_price_billion_vnd")


@query
def batch_score_summary(spark, d):
    renamed = requests(spark, d).withColumnsRenamed({"direction_text": "direction", "legal_text": "legal"})
    return training.batch_summary(training.score_batch(renamed, whole_model(spark, d)))


# Metrics and alerts


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def counter_rate(spark, d):
    names = [fixed.CONSUMED, fixed.PROCESSED, fixed.FAILED]
    return rounded(monitor.counter_rate(tables.metric_samples(spark, d, [fixed.CONSUMED, fixed.PROCESSED, fixed.FAILED]), names), "rate")


@query
def alert_error_rate(spark, d):
    return rounded(monitor.alert_error_rate(tables.metric_samples(spark, d, [fixed.FAILED, fixed.CONSUMED])), "value")


@query
def alert_lag(spark, d):
    return monitor.alert_lag(tables.metric_samples(spark, d, [fixed.LAG]))


@query
def alert_duration(spark, d):
    return rounded(monitor.alert_duration(tables.metric_samples(spark, d, [fixed.DURATION_SUM, fixed.DURATION_COUNT])), "value")


@query
def alert_training_failed(spark, d):
    return monitor.alert_training_failed(tables.metric_samples(spark, d, [fixed.RUNS_FAILED]))


@query
def alert_stale(spark, d):
    return rounded(monitor.alert_stale(tables.metric_samples(spark, d, [fixed.LAST_SUCCESS])), "value")


@query
def alert_write_failures(spark, d):
    return rounded(monitor.alert_write_failures(tables.metric_samples(spark, d, [fixed.WRITES_FAILED])), "value")


@query
def alert_firing(spark, d):
    return monitor.alert_episodes(tables.metric_samples(spark, d))


@query
def latest_gauges(spark, d):
    return monitor.latest_values(tables.metric_samples(spark, d, [fixed.MAE, fixed.RMSE, fixed.R2, fixed.SAMPLES]), [fixed.MAE, fixed.RMSE, fixed.R2, fixed.SAMPLES])


@query
def duration_histogram(spark, d):
    bounds = [0.5, 1, 5, 10, 25, 50, 100, 250]
    return monitor.histogram(tables.read(spark, d, "events"), F.col("value"), bounds, "event_type")


@query
def latency_percentiles(spark, d):
    fractions = [0.5, 0.95, 0.99]
    events = tables.read(spark, d, "events")
    found = order_stats.percentiles(events, "event_type", "value", fractions)
    names = sorted({key for key, _ in found})
    rows = [(n, *[round(found[(n, f)], 6) for f in fractions]) for n in names]
    return spark.createDataFrame(rows, "event_type string, p50 double, p95 double, p99 double")


# Metric, comparator, limit, seconds that it must hold, severity.
THRESHOLD_RULES = [
    (fixed.R2, "<", 0.75, 0.0, "HIGH"),
    (fixed.MAE, ">", 500e6, 0.0, "HIGH"),
    (fixed.LAG, ">", 1000.0, 600.0, "MEDIUM"),
    (fixed.SAMPLES, "<", 5000.0, 3600.0, "HIGH"),
    (fixed.RUNS_FAILED, "=", 3.0, 900.0, "CRITICAL"),
]


@query
def threshold_alerts(spark, d):
    schema = "name string, comparator string, threshold double, hold double, severity string"
    rules = spark.createDataFrame(THRESHOLD_RULES, schema)
    return monitor.threshold_alerts(tables.metric_samples(spark, d, [r[0] for r in THRESHOLD_RULES]), rules)


STAGE_LIMITS = [("signup", 2.0, 5.0), ("click", 1.0, 2.0), ("view", 0.5, 1.0), ("error", 0.1, 0.5), ("purchase", 0.1, 0.5)]


@query
def stage_error_rates(spark, d):
    """Failure share per stage (event type) against its target and alert level; large values count as failures."""
    limits = spark.createDataFrame(STAGE_LIMITS, "event_type string, target_pct double, alert_pct double")
    rates = tables.read(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > 230).alias("failed")
    )
    share = F.round(quality.ratio(F.col("failed") * 100.0, F.col("total")), 6)
    return rates.join(limits, "event_type").select(
        "event_type", "total", "failed", share.alias("error_pct"), (share > F.col("target_pct")).alias("off_target"),
        (share > F.col("alert_pct")).alias("alert"),
    )


# Names of queries whose function would hide a library function of that name.
for _name in [n for n in REGISTRY if n.endswith("_query")]:
    REGISTRY[_name.removesuffix("_query")] = REGISTRY.pop(_name)
