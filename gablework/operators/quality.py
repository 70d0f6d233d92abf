"""Dataset quality: report aggregates, completeness, outliers, scores, gates, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def summary(features: DataFrame) -> DataFrame:
    """Totals and shares of candidates and priced listings, one pass."""
    counts = features.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("is_model_candidate")).alias("model_candidates"),
        F.count_if(F.col("price_vnd") > 0).alias("records_with_target_price"),
    )
    return counts.select(
        "*",
        ratio(F.col("model_candidates"), F.col("total_records")).alias("candidate_ratio"),
        ratio(F.col("records_with_target_price"), F.col("total_records")).alias("price_ratio"),
    )


def group_counts(features: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value (NULL included), most frequent first, ties by value; optionally only the first ``top``."""
    counts = features.groupBy(column).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc_nulls_first(column))
    return ordered.limit(top) if top else ordered


def report(features: DataFrame, top: int = 20) -> DataFrame:
    """The quality report as one JSON document.

    One aggregation to (type, province) cells serves totals and both lists; the lists hold one entry per
    property type and at most ``top`` provinces.
    """
    cells = features.groupBy("property_type", "province_slug").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("is_model_candidate")).alias("candidates"),
        F.count_if(F.col("price_vnd") > 0).alias("priced"),
    )

    def listed(counts: DataFrame, column: str, name: str) -> DataFrame:
        entry = F.struct((-F.col("count")).alias("rank"), F.col(column).alias("_id"), F.col("count"))
        return counts.agg(
            F.transform(
                F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["_id"].alias("_id"), e["count"].alias("count"))
            ).alias(name)
        )

    types = cells.groupBy("property_type").agg(F.sum("rows").alias("count"))
    provinces = cells.groupBy("province_slug").agg(F.sum("rows").alias("count"))
    best = provinces.orderBy(F.desc("count"), F.asc_nulls_first("province_slug")).limit(top)
    totals = cells.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("model_candidates"),
        F.coalesce(F.sum("priced"), F.lit(0)).alias("records_with_target_price"),
    ).select(
        "*",
        ratio(F.col("model_candidates"), F.col("total_records")).alias("candidate_ratio"),
        ratio(F.col("records_with_target_price"), F.col("total_records")).alias("price_ratio"),
    )
    whole = totals.select(
        "*",
        listed(types, "property_type", "property_type_distribution").scalar().alias("property_type_distribution"),
        listed(best, "province_slug", "top_provinces").scalar().alias("top_provinces"),
    )
    return whole.select(F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("report"))


def completeness(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Filled share per column in percent and whether its missing share is above the limit (percent).

    One pass for all columns; the wide single row is turned into one row per column afterwards.
    """
    filled = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in limits])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.lit(m).alias("max_missing_pct")) for c, m in limits.items()])
    ).alias("f")
    rows = filled.select("total", pairs).select("f.field", "f.filled", "total", "f.max_missing_pct")
    share = F.round(ratio(F.col("filled") * 100.0, F.col("total")), 6)
    return rows.select(
        "field",
        "filled",
        "total",
        share.alias("completeness_pct"),
        (100.0 - share > F.col("max_missing_pct")).alias("alert"),
    )


def outlier_flags(df: DataFrame) -> DataFrame:
    """Add ``outliers``: names of the ranges a listing falls out of."""
    price, area, rate = F.col("price_vnd"), F.col("area_m2"), F.col("price_per_m2_vnd")
    rules = [
        (price < 100e6, "price_too_low"),
        (price > 500e9, "price_too_high"),
        (area < 5, "area_too_small"),
        (area > 10000, "area_too_large"),
        (rate < 1e6, "price_per_m2_too_low"),
        (rate > 1e9, "price_per_m2_too_high"),
    ]
    return df.withColumn("outliers", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in rules])))


def accurate() -> Column:
    """Whether a listing passes every accuracy rule; a missing value fails its rule, missing bedrooms pass."""
    rooms = F.coalesce(F.col("bedroom_count").between(0, 20), F.lit(True))
    rules = (
        (F.col("price_vnd") > 10e6)
        & (F.col("price_vnd") < 500e9)
        & (F.col("area_m2") > 0)
        & (F.col("area_m2") < 10000)
        & (F.col("price_per_m2_vnd") > 1e6)
        & (F.col("price_per_m2_vnd") < 1e9)
        & F.col("property_type").isin(fixed.PROPERTY_TYPES)
    )
    return F.coalesce(rules, F.lit(False)) & rooms


def epoch_seconds(text: Column) -> Column:
    """Seconds since the epoch of an ISO text that carries its offset."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def quality_score(features: DataFrame, now: str) -> DataFrame:
    """Completeness, nullability, accuracy, freshness (each 0 to 100) and their mean, one pass."""
    named = [
        F.col("url").isNotNull(),
        F.col("listing_id").isNotNull(),
        F.col("property_type").isNotNull(),
        F.col("province_slug").isNotNull(),
        F.col("price_vnd").isNotNull() | F.col("raw_price_text").isNotNull(),
        F.col("area_m2").isNotNull() | F.col("raw_area_text").isNotNull(),
    ]
    filled = sum((c.cast("int") for c in named[1:]), named[0].cast("int"))
    critical = named[0] & named[1] & named[2] & named[3]
    age = (epoch_seconds(F.lit(now)) - epoch_seconds(F.max("updated_at"))) / 3600
    parts = features.agg(
        F.count("*").alias("total"),
        F.sum(filled).alias("filled"),
        F.count_if(critical).alias("complete"),
        F.count_if(accurate()).alias("accurate"),
        age.alias("age_hours"),
    ).select(
        ratio(F.col("filled") * 100.0, F.col("total") * 6).alias("completeness"),
        ratio(F.col("complete") * 100.0, F.col("total")).alias("nullability"),
        ratio(F.col("accurate") * 100.0, F.col("total")).alias("accuracy"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("age_hours") / 24 * 100)).alias("freshness"),
    )
    names = ["completeness", "nullability", "accuracy", "freshness"]
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / 4
    return parts.select(*[F.round(n, 6).alias(n) for n in names], F.round(mean, 6).alias("quality_score"))


def duplicate_rate(df: DataFrame, key: str = "url") -> DataFrame:
    """Rows beyond the first of each key, as a count and in percent. Counting per key first keeps hot keys cheap."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    extra = F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(total.alias("total"), extra.alias("duplicates")).select(
        "total", "duplicates", F.round(ratio(F.col("duplicates") * 100.0, F.col("total")), 6).alias("duplicate_pct")
    )


def consistency(df: DataFrame) -> DataFrame:
    """Counts of listings scraped after their update and of per-m² prices more than 1 % off."""
    expected = F.when(F.col("area_m2") > 0, F.col("price_vnd") / F.col("area_m2"))
    off = F.abs(F.col("price_per_m2_vnd") - expected) > 0.01 * expected
    late = epoch_seconds(F.col("scraped_at")) > epoch_seconds(F.col("updated_at"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(late).alias("scraped_after_update"),
        F.count_if(F.col("price_per_m2_vnd").isNotNull() & expected.isNotNull()).alias("price_checked"),
        F.count_if(off).alias("price_inconsistent"),
    )


def freshness_tier(age_hours: Column) -> Column:
    return (
        F.when(age_hours < 1, "fresh")
        .when(age_hours <= 4, "ok")
        .when(age_hours <= 24, "late")
        .when(age_hours <= 30 * 24, "warning")
        .otherwise("critical")
    )


def freshness_tiers(df: DataFrame, now: str, column: str = "updated_at") -> DataFrame:
    age = (epoch_seconds(F.lit(now)) - epoch_seconds(F.col(column))) / 3600
    return df.groupBy(freshness_tier(age).alias("tier")).agg(F.count("*").alias("count"))


def newer_than(df: DataFrame, now: str, days: float, column: str) -> DataFrame:
    """Rows whose timestamp text is at most ``days`` before ``now`` and not after it."""
    end = epoch_seconds(F.lit(now))
    return df.where(epoch_seconds(F.col(column)).between(end - days * 86400, end))


def raw_schema_checks(df: DataFrame) -> DataFrame:
    """Rejections per raw field rule, one pass. Optional fields are checked only where present."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    required = {
        "url": F.col("url").startswith(fixed.BASE_URL),
        "listing_id": F.col("listing_id").rlike("^[0-9A-Za-z]+$"),
        "property_type": F.col("property_type").isin(fixed.PROPERTY_TYPES),
        "province_slug": F.col("province_slug").rlike("^[0-9a-z]+(-[0-9a-z]+)*$"),
        "scraped_at": F.col("scraped_at").rlike(iso) & F.try_to_timestamp("scraped_at").isNotNull(),
    }
    optional = {
        "title": F.length("title") <= 500,
        "price_text": F.lower("price_text").rlike(r"\d.*(tỷ|triệu)"),
        "area_text": F.col("area_text").rlike(r"\d.*m²"),
        "verified": F.col("verified").isin(0, 1),
    }
    checks = [(n, ~F.coalesce(t, F.lit(False))) for n, t in required.items()]
    checks += [(n, ~F.coalesce(t, F.lit(True))) for n, t in optional.items()]
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(bad).alias(n) for n, bad in checks])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("violations")) for n, _ in checks]))
    return counts.select("total", rows.alias("r")).select("r.field", "r.violations", "total")


def request_errors() -> Column:
    """ARRAY of field names a scoring request fails on: sizes must be positive, counts not negative."""
    sizes = [(F.col(c) <= 0, c) for c in ["area_m2", "front_width_m", "road_width_m"]]
    counts = [(F.col(c) < 0, c) for c in ["bedroom_count", "bathroom_count", "floor_count"]]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in sizes + counts]))


def request_codes() -> Column:
    """ARRAY of 'code:field' for a scoring request: 1001 missing, 1003 out of range, 1004 unknown value."""
    ranges = {
        "area_m2": (F.col("area_m2") > 0) & (F.col("area_m2") <= 10000),
        "bedroom_count": F.col("bedroom_count").between(0, 20),
        "bathroom_count": F.col("bathroom_count").between(0, 10),
        "floor_count": F.col("floor_count").between(0, 50),
        "front_width_m": F.col("front_width_m").between(0, 100),
        "road_width_m": F.col("road_width_m").between(0, 100),
    }
    checks = [(F.col(c).isNull(), f"1001:{c}") for c in ["area_m2", "property_type"]]
    checks += [(~ok, f"1003:{name}") for name, ok in ranges.items()]
    checks += [(~F.col("property_type").isin(fixed.PROPERTY_TYPES), "1004:property_type")]
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]))


def typed_request(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text fields of requests; ``type_errors`` lists '1002:field' for values of the wrong type."""
    wrong = F.array_compact(
        F.array(
            *[
                F.when(F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), F.lit(f"1002:{n}"))
                for n, t in types.items()
            ]
        )
    )
    return df.withColumn("type_errors", wrong).withColumns({n: F.col(n).try_cast(t) for n, t in types.items()})


def gate(passed: Column, warned: Column) -> Column:
    return F.when(passed, "ACCEPT").when(warned, "WARN").otherwise("REJECT")
