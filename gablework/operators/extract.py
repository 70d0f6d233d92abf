"""Stored list and detail pages to links and raw listing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.html import element_links, element_texts, page_tokens, pair_map
from ..functions.text import blank_to_null, clean_text
from ..functions.urls import list_page_url, location_parts, property_type_from_url

# Selectors of the listing site's pages.
LIST_SELECTORS = {
    "container": "div.re__srp-list",
    "cards": ["div.re__card-full", "div.re__card-full-label-verified"],
    "link": "a.js__product-link-for-product-id",
}
DETAIL_SELECTORS = {
    "title": ["h1"],
    "short_titles": [".re__pr-short-info-item", ".title"],
    "short_values": [".re__pr-short-info-item", ".value"],
    "spec_titles": [".re__pr-specs-content-item-title"],
    "spec_values": [".re__pr-specs-content-item-value"],
    "body": [".re__section-body", "*"],
    "breadcrumb": [".re__breadcrumb", "li", "*"],
}


def listing_links(pages: DataFrame, selectors: dict = LIST_SELECTORS, base: str = fixed.BASE_URL) -> DataFrame:
    """(page columns except html, pos, link) for every listing card of every list page."""
    links = element_links(
        page_tokens(F.col("html")), selectors["container"], selectors["cards"], selectors["link"], base
    )
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(links).alias("pos", "link"))


def page_parts(pages: DataFrame, selectors: dict = DETAIL_SELECTORS) -> DataFrame:
    """One ARRAY column of texts per selector; a page is cut into tokens once for all of them."""
    kept = [c for c in pages.columns if c != "html"]
    tokens = pages.select(*kept, page_tokens(F.col("html")).alias("_tokens"))
    return tokens.select(*kept, *[element_texts(F.col("_tokens"), steps).alias(n) for n, steps in selectors.items()])


def detail_records(
    pages: DataFrame, scraped_at: Column, verified: bool = True, selectors: dict = DETAIL_SELECTORS
) -> DataFrame:
    """Raw listing records of detail pages (url, html); an empty value falls through to its second place."""
    parts = page_parts(pages, selectors)
    mapped = parts.withColumns(
        {
            "short": pair_map(F.col("short_titles"), F.col("short_values")),
            "spec": pair_map(F.col("spec_titles"), F.col("spec_values")),
            "place": location_parts(F.col("url")),
        }
    )

    def labelled(field: str) -> Column:
        *firsts, (block, label) = fixed.DETAIL_LABELS[field]
        value = F.try_element_at(F.col(block), F.lit(label))
        for block, label in reversed(firsts):
            value = F.coalesce(blank_to_null(F.try_element_at(F.col(block), F.lit(label))), value)
        return value

    crumbs, body = F.col("breadcrumb"), F.col("body")
    fields = {
        **{field: labelled(field) for field in fixed.DETAIL_LABELS},
        "title": clean_text(F.try_element_at(F.col("title"), F.lit(1))),
        "property_type": property_type_from_url(F.col("url")),
        "project_hint": F.when(F.size(crumbs) >= 2, F.try_element_at(crumbs, F.lit(-2))),
        "verified": F.lit(int(verified)),
        "source": F.lit(fixed.RECORD_SOURCE),
        "description": F.when(F.size(body) > 0, F.array_join(F.slice(body, 1, fixed.DESCRIPTION_PARTS), " ")),
        "scraped_at": scraped_at,
    }
    return mapped.select("url", *[column.alias(name) for name, column in fields.items()], "place.*")


def page_frontier(configs: DataFrame, verified: bool = True, extra: dict | None = None) -> DataFrame:
    """List page addresses for crawl windows (start_page, max_pages, next_page): resumed where it stopped."""
    first = F.greatest(F.col("start_page"), F.coalesce(F.col("next_page"), F.col("start_page")))
    last = F.col("start_page") + F.col("max_pages") - 1
    pages = F.when(first <= last, F.sequence(first, last))
    kept = configs.columns
    return configs.select(*kept, F.explode(pages).alias("page")).withColumn(
        "list_url", list_page_url(F.col("page"), verified, extra)
    )


def unseen(links: DataFrame, seen: DataFrame, key: str = "link") -> DataFrame:
    """Links that are not in the table of seen ones, each once. The whole seen set is kept, not only the newest."""
    return links.select(key).distinct().join(seen.select(key), key, "left_anti")


def before_first_empty_page(pages: DataFrame, page: str, link_count: str) -> DataFrame:
    """Pages of a crawl in front of its first page without links."""
    first_empty = pages.where(F.col(link_count) == 0).agg(F.min(page)).scalar()
    return pages.where(F.coalesce(F.col(page) < first_empty, F.lit(True)))


def with_remaining_budget(links: DataFrame, order: list[str], max_items: int, emitted_before: int) -> DataFrame:
    """The next links of a crawl limited to ``max_items`` over all its restarts."""
    return links.orderBy(*order).limit(max(max_items - emitted_before, 0))
