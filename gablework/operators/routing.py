"""Messages to listings, dead letters and audit rows; offsets, lag and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.values import flag_field
from .normalize import NORMALIZED_COLUMNS, normalize, validate

# The fields of a raw listing record, in record order.
RAW_FIELDS = [
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
    "verified",
    "source",
    "description",
    "scraped_at",
    "location_slug",
    "province_slug",
    "district_slug",
    "ward_slug",
]
POSITION = ["topic", "partition", "offset"]
NOT_JSON, NOT_OBJECT, BAD_FLAG = "invalid_json", "not_an_object", "verified_not_an_integer"


def decode(messages: DataFrame) -> DataFrame:
    """Add ``payload`` (VARIANT) and ``error``: NULL for an object that can be normalised.

    Values stay typed as in the JSON text, so 1.234 and "1.234" remain different numbers.
    """
    parsed = messages.withColumn("payload", F.try_parse_json(F.col("value").cast("string")))
    fields = parsed.withColumn("verified", F.try_variant_get("payload", "$.verified", "variant"))
    _, readable = flag_field(fields, "verified")
    kind = F.schema_of_variant(F.col("payload"))
    error = (
        F.when(F.col("payload").isNull(), NOT_JSON)
        .when(~kind.startswith("OBJECT"), NOT_OBJECT)
        .when(~readable, BAD_FLAG)
    )
    return fields.withColumn("error", error).drop("verified")


def raw_fields(decoded: DataFrame) -> DataFrame:
    """Fields of decoded payloads as VARIANT columns, with the message position."""
    return decoded.select(
        *[F.try_variant_get("payload", f"$.{name}", "variant").alias(name) for name in RAW_FIELDS],
        *[F.col(name) for name in POSITION],
    )


def route(messages: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(validated listings with their position, dead letters) of a message frame."""
    decoded = decode(messages)
    listings = normalize(raw_fields(decoded.where("error is null")), now, keep=POSITION)
    return validate(listings), dead_letters(decoded.where("error is not null"))


def routed(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Every message once with its ``branch`` (feature, invalid or dead), in a single pass.

    Listing columns of dead messages are NULL; ``validation_errors`` is empty for features.
    """
    decoded = decode(messages)
    fields = [F.try_variant_get("payload", f"$.{name}", "variant").alias(name) for name in RAW_FIELDS]
    checked = validate(normalize(decoded.select(*fields, *POSITION, "error"), now, keep=[*POSITION, "error"]))
    alive = F.col("error").isNull()
    listing = [F.when(alive, F.col(c)).alias(c) for c in [*NORMALIZED_COLUMNS, "validation_errors"]]
    branch = F.when(~alive, "dead").when(F.size("validation_errors") == 0, "feature").otherwise("invalid")
    return checked.select(*POSITION, branch.alias("branch"), "error", *listing)


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Undecodable messages in the dead-letter layout; the value is kept as bytes and so never lost."""
    return decoded.select(
        F.when(F.col("error") == BAD_FLAG, "payload").otherwise("raw").alias("kind"),
        F.col("value").cast("binary").alias("raw"),
        F.when(F.col("error") == BAD_FLAG, F.col("value").cast("string")).alias("payload"),
        F.lit(None).cast("string").alias("normalized"),
        "error",
        *POSITION,
    )


def failed_writes(rows: DataFrame, error: Column, normalized: bool) -> DataFrame:
    """Dead letters for rows whose write failed: the payload, with the normalised form where there is one."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in POSITION]), {"ignoreNullFields": "false"})
    return rows.select(
        F.lit("normalized" if normalized else "payload").alias("kind"),
        F.lit(None).cast("binary").alias("raw"),
        (F.lit(None).cast("string") if normalized else body).alias("payload"),
        (body if normalized else F.lit(None).cast("string")).alias("normalized"),
        error.alias("error"),
        *POSITION,
    )


def raw_envelope(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(key, value) messages of raw records: key is the url, value the whole record as JSON, nulls included."""
    body = F.to_json(F.struct(*(columns or RAW_FIELDS)), {"ignoreNullFields": "false"})
    return df.select(F.col("url").alias("key"), body.alias("value"))


def feature_envelope(validated: DataFrame) -> DataFrame:
    """(key, value) audit messages of valid and rejected listings; only rejected ones carry the errors."""
    keep_nulls = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*NORMALIZED_COLUMNS), keep_nulls)
    with_errors = F.to_json(F.struct(*NORMALIZED_COLUMNS, "validation_errors"), keep_nulls)
    value = F.when(F.size("validation_errors") == 0, plain).otherwise(with_errors)
    return validated.select(F.col("url").alias("key"), value.alias("value"))


def replay_dedup(messages: DataFrame) -> DataFrame:
    """Each message position once, however often it was delivered."""
    return messages.dropDuplicates(POSITION)


def offset_checkpoint(messages: DataFrame, group: str = fixed.CONSUMER_GROUP) -> DataFrame:
    return (
        messages.groupBy("topic", "partition")
        .agg(F.max("offset").alias("last_processed_offset"))
        .select(
            F.lit(group).alias("group_id"),
            "topic",
            "partition",
            "last_processed_offset",
            (F.col("last_processed_offset") + 1).alias("committed_offset"),
        )
    )


def consumer_lag(checkpoint: DataFrame, high_watermarks: DataFrame) -> DataFrame:
    """Messages still unread per partition. Both sides have one row per partition."""
    lag = F.greatest(F.col("high") - F.coalesce("last_processed_offset", F.lit(-1)) - 1, F.lit(0))
    return high_watermarks.join(checkpoint, ["topic", "partition"], "left").select(
        "topic", "partition", F.col("high").alias("high_watermark"), lag.cast("bigint").alias("lag")
    )


def message_counters(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Totals of one run as one row, in a single pass over the messages. Writes are counted where they are made."""
    decoded = decode(messages)
    fields = decoded.select(
        "error",
        *[F.try_variant_get("payload", f"$.{name}", "variant").alias(name) for name in RAW_FIELDS],
    )
    checked = validate(normalize(fields, now, keep=["error"]))
    ok = F.col("error").isNull()
    valid = ok & (F.size("validation_errors") == 0)
    return checked.agg(
        F.count("*").alias("consumed"),
        F.count_if(valid).alias("processed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & ~valid).alias("rejected"),
    )
