"""Derived columns of a normalised listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import blank_to_null, clean_text

# The fields of the search text, of the training text, and those the coverage score counts, in order.
TEXT_PARTS = [
    "title",
    "property_type",
    "province_slug",
    "district_slug",
    "ward_slug",
    "project_hint",
    "furniture",
    "legal",
    "direction",
    "description",
]
TRAIN_TEXT_PARTS = ["title", "property_type", "province_slug", "district_slug", "legal", "description"]
COVERED = [
    "area_m2",
    "price_vnd",
    "bedroom_count",
    "bathroom_count",
    "floor_count",
    "front_width_m",
    "road_width_m",
    "property_type",
    "province_slug",
    "district_slug",
]


def text_features(parts: list[Column] | None = None, cleaned: bool = False) -> Column:
    """Present text parts joined by ' | '; '' when none is. ``cleaned`` skips cleaning parts that already are."""
    columns = parts or [F.col(name) for name in TEXT_PARTS]
    return F.concat_ws(" | ", *[column if cleaned else clean_text(column) for column in columns])


def train_text(text: Column, parts: list[Column] | None = None) -> Column:
    """Stored text, or where it is missing the uncleaned training parts joined by ' | '."""
    columns = parts or [F.col(name) for name in TRAIN_TEXT_PARTS]
    return F.coalesce(blank_to_null(text), F.concat_ws(" | ", *[blank_to_null(c) for c in columns]))


def coverage_score(columns: list[Column] | None = None) -> Column:
    """How many of the ten key fields are present."""
    present = [c.isNotNull().cast("int") for c in (columns or [F.col(name) for name in COVERED])]
    return reduce(lambda a, b: a + b, present)


def has_target_price(price: Column) -> Column:
    return F.coalesce(price > 0, F.lit(False))


def is_model_candidate(has_price: Column, area: Column, property_type: Column, score: Column) -> Column:
    return F.coalesce(
        has_price & (area > 0) & (property_type != "") & (score >= fixed.MIN_CANDIDATE_COVERAGE), F.lit(False)
    )


def validation_errors(
    url: Column | None = None,
    price: Column | None = None,
    area: Column | None = None,
    per_m2: Column | None = None,
    unreadable: dict[str, Column] | None = None,
) -> Column:
    """ARRAY of error names in a fixed order; empty when the listing is valid. Zero counts as missing in the
    per-m² check but not in the range checks. ``unreadable`` tells of "price" and "area" where the field holds
    something that is not a number; its value is then to be NULL."""
    url = F.col("url") if url is None else url
    price = F.col("price_vnd") if price is None else price
    area = F.col("area_m2") if area is None else area
    per_m2 = F.col("price_per_m2_vnd") if per_m2 is None else per_m2
    expected = F.when(area != 0, price / area)
    slack = F.greatest(F.lit(fixed.PER_M2_ABS_TOLERANCE), expected * fixed.PER_M2_REL_TOLERANCE)
    inconsistent = (price != 0) & (per_m2 != 0) & (expected != 0) & (F.abs(expected - per_m2) > slack)
    invalid = {"price": F.lit(False), "area": F.lit(False)} | (unreadable or {})
    checks = [
        (F.coalesce(url, F.lit("")) == "", "missing_url"),
        (price <= 0, "price_non_positive"),
        (price > fixed.MAX_PRICE_VND, "price_too_large"),
        (invalid["price"], "price_invalid"),
        (area <= 0, "area_non_positive"),
        (area > fixed.MAX_AREA_M2, "area_too_large"),
        (invalid["area"], "area_invalid"),
        (inconsistent, "price_per_m2_inconsistent"),
    ]
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in checks]))
