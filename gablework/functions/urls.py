"""URL columns: resolution, property type, location slugs, list page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import let


def dotless_path(path: Column) -> Column:
    """The absolute path, without ``.`` and ``..`` steps, that a path on a page of the root leads to. One pass over
    the steps; inner empty ones go where the path is relative."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    inner = F.concat(F.array(F.lit("")), F.filter(parts, lambda s, i: (s != "") | (i == last)))
    steps = F.when(path.startswith("/"), parts).otherwise(inner)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    ends_in_step = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_in_step, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(href: Column, base: str = fixed.BASE_URL) -> Column:
    """Absolute form of a link found on a page of the site root ``base``."""
    host = base.rstrip("/")
    scheme = host.split(":", 1)[0]
    path = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    rest = F.substring(href, F.length(path) + 1, F.length(href))
    # Most links have no such steps; the pass over the steps is for those that do.
    stepped = path.rlike(r"(^|/)\.{1,2}(/|$)") | path.rlike("[^/]//")
    plain = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.rlike(r"^[?#]"), F.concat(F.lit(host), href))
        .otherwise(F.concat(F.lit(host), F.when(stepped, dotless_path(path)).otherwise(plain), rest))
    )


def property_type_from_url(url: Column) -> Column:
    """First known slug contained in the URL, in the fixed order; NULL when none is."""
    (slug, label), *others = fixed.PROPERTY_TYPE_SLUGS
    column = F.when(url.contains(slug), F.lit(label))
    for slug, label in others:
        column = column.when(url.contains(slug), F.lit(label))
    return column


def url_path(url: Column) -> Column:
    """Path part without query, parameters of the last segment and fragment, and without outer slashes.

    A plain pattern rather than ``parse_url``, which fails or gives NULL on the odd characters real links carry.
    """
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*?)(?:;[^/?#]*)?(?:[?#]|$)", 1), r"^/+|/+$", "")


def location_parts(url: Column) -> Column:
    """STRUCT(location_slug, province_slug, district_slug, ward_slug) from the first path segment.

    After the first 'tai' the last two tokens are the province, the one before the district, then the ward.
    """
    slug = F.nullif(F.substring_index(url_path(url), "/", 1), F.lit(""))
    return let(slug, lambda s: let(_tail(s), lambda tail: _place(s, tail)))


def _tail(slug: Column) -> Column:
    """Tokens after the first 'tai', NULL when it is absent or last."""
    rest = F.when(slug.rlike("^(?:[^-]*-)*?tai-"), F.regexp_extract(slug, "^(?:[^-]*-)*?tai-(.*)$", 1))
    return F.split(rest, "-")


def _place(slug: Column, tail: Column) -> Column:
    return F.struct(
        slug.alias("location_slug"),
        F.array_join(F.slice(tail, -F.least(F.size(tail), F.lit(2)), F.lit(2)), "-").alias("province_slug"),
        F.try_element_at(tail, F.lit(-3)).alias("district_slug"),
        F.try_element_at(tail, F.lit(-4)).alias("ward_slug"),
    )


def form_encode(text: Column) -> Column:
    """Query-string encoding that leaves '~' alone and encodes '*'."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def list_page_url(
    page: Column,
    verified: bool = True,
    extra: dict[str, Column | str | None] | None = None,
    base: str = fixed.BASE_URL,
    path: str = fixed.LIST_PATH,
) -> Column:
    """Address of one list page. Extra parameters override, NULL ones are dropped."""
    params: dict[str, Column] = {}
    if verified:
        params[fixed.VERIFIED_QUERY[0]] = F.lit(fixed.VERIFIED_QUERY[1])
    params["page"] = page.cast("string")
    for name, value in (extra or {}).items():
        if value is not None:
            given = value if isinstance(value, Column) else F.lit(str(value))
            params[name] = F.coalesce(given.cast("string"), params[name]) if name in params else given.cast("string")
    pairs = [F.concat(form_encode(F.lit(name)), F.lit("="), form_encode(value)) for name, value in params.items()]
    return F.concat(F.lit(f"{base}{path}?"), F.concat_ws("&", *pairs))
