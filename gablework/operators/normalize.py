"""Raw listing records to typed, flat listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.listing import COVERED, coverage_score, has_target_price, is_model_candidate, text_features
from ..functions.listing import validation_errors
from ..functions.numbers import half_even_int, parse_price
from ..functions.text import blank_to_null, clean_text
from ..sources.values import flag_field, number_field, strict_number, text_field

# Output column <- raw field, for the plain text columns.
_TEXTS = {
    "listing_id": "listing_id",
    "title": "title",
    "property_type": "property_type",
    "listing_type": "listing_type",
    "province_slug": "province_slug",
    "district_slug": "district_slug",
    "ward_slug": "ward_slug",
    "location_slug": "location_slug",
    "direction": "direction_text",
    "legal": "legal_text",
    "furniture": "furniture_text",
    "project_hint": "project_hint",
    "description": "description",
    "posted_date_text": "posted_date_text",
    "raw_price_text": "price_text",
    "raw_area_text": "area_text",
    "raw_bedroom_text": "bedroom_text",
    "raw_bathroom_text": "bathroom_text",
    "raw_floor_text": "floor_text",
    "raw_front_width_text": "front_width_text",
    "raw_road_width_text": "road_width_text",
}
_NUMBERS = {
    "area_m2": "area_text",
    "bedroom_count": "bedroom_text",
    "bathroom_count": "bathroom_text",
    "floor_count": "floor_text",
    "front_width_m": "front_width_text",
    "road_width_m": "road_width_text",
}
_COUNTS = {"bedroom_count", "bathroom_count", "floor_count"}

# The columns of a normalised listing, in record order.
NORMALIZED_COLUMNS = [
    "url",
    "listing_id",
    "title",
    "property_type",
    "listing_type",
    "province_slug",
    "district_slug",
    "ward_slug",
    "location_slug",
    "direction",
    "legal",
    "furniture",
    "project_hint",
    "description",
    "verified",
    "posted_date_text",
    "raw_price_text",
    "raw_area_text",
    "raw_bedroom_text",
    "raw_bathroom_text",
    "raw_floor_text",
    "raw_front_width_text",
    "raw_road_width_text",
    "area_m2",
    "bedroom_count",
    "bathroom_count",
    "floor_count",
    "front_width_m",
    "road_width_m",
    "price_vnd",
    "price_per_m2_vnd",
    "has_target_price",
    "text_features",
    "source",
    "scraped_at",
    "updated_at",
    "feature_coverage_score",
    "is_model_candidate",
]


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def normalize(df: DataFrame, now: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The 38 columns of a normalised listing, plus the ``keep`` columns of the input unchanged.

    Works on string, numeric or VARIANT fields; absent fields count as NULL. Staged as three projections, so
    each pattern runs once per row: texts and numbers, then the price (it needs the area), then the scores.
    """
    keep = keep or []
    now = utc_now() if now is None else now
    verified, _ = flag_field(df, "verified")
    numbers = {}
    for name, field in _NUMBERS.items():
        number = number_field(df, field)
        numbers[name] = half_even_int(number) if name in _COUNTS else number
    texts = df.select(
        text_field(df, "url").alias("url"),
        *[clean_text(text_field(df, field)).alias(name) for name, field in _TEXTS.items()],
        *[column.alias(name) for name, column in numbers.items()],
        verified.alias("verified"),
        text_field(df, "price_text").alias("_price_text"),
        F.coalesce(clean_text(text_field(df, "source")), F.lit(fixed.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(blank_to_null(text_field(df, "scraped_at")), now).alias("scraped_at"),
        now.alias("updated_at"),
        *[F.col(name).alias(f"_keep_{name}") for name in keep],
    )
    priced = texts.withColumn("_price", parse_price(F.col("_price_text"), F.col("area_m2")))
    priced = priced.withColumns({"price_vnd": F.col("_price.total"), "price_per_m2_vnd": F.col("_price.per_m2")})
    scored = priced.withColumns(
        {
            "has_target_price": has_target_price(F.col("price_vnd")),
            "feature_coverage_score": coverage_score([F.col(name) for name in COVERED]),
        }
    )
    finished = scored.withColumns(
        {
            "is_model_candidate": is_model_candidate(
                F.col("has_target_price"), F.col("area_m2"), F.col("property_type"), F.col("feature_coverage_score")
            ),
            "text_features": text_features(cleaned=True),
        }
    )
    return finished.select(*NORMALIZED_COLUMNS, *[F.col(f"_keep_{name}").alias(name) for name in keep])


def validate(df: DataFrame) -> DataFrame:
    """Add ``validation_errors``; a listing is valid when it is empty. Also takes normalised records of other origin,
    whose price or area may be VARIANT or text: what is no number there is ``price_invalid`` or ``area_invalid``."""
    values, unreadable = {}, {}
    for field, name in (("price", "price_vnd"), ("area", "area_m2"), ("per_m2", "price_per_m2_vnd")):
        values[field], bad = strict_number(df, name)
        if bad is not None and field != "per_m2":
            unreadable[field] = F.coalesce(bad, F.lit(False))
    return df.withColumn("validation_errors", validation_errors(**values, unreadable=unreadable))
