"""Stored web pages as columns: texts and links under simple selectors, entities, title/value pairs.

A page is cut into tags and texts and folded once with the higher-order function ``aggregate``; nothing is
shuffled and no Python runs per page. A selector is a list of steps, outermost first, each ``"tag"``,
``".class"``, ``"tag.class"`` or ``"*"``, joined by "is inside". Unclosed inline tags are closed by the end of
their parent; scripts, styles and comments are ignored.
"""

from __future__ import annotations

import json
import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text
from .urls import resolve_url

_INVISIBLE = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_TOKEN = r"<[^>]+>|[^<]+"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Elements without content, and elements whose start ends an open sibling of the same name.
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_SELF_ENDING = ["li", "p", "option", "tr", "td", "th", "dt", "dd"]


def page_tokens(html: Column) -> Column:
    """Visible tags and texts of a page in order."""
    return F.regexp_extract_all(F.regexp_replace(html, _INVISIBLE, ""), F.lit(_TOKEN), F.lit(0))


def _attribute(token: Column, name: str) -> Column:
    """Value of an attribute, '' when it is absent or empty."""
    return F.regexp_extract(
        token, rf"""(?is)\s{name}\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|[^\s"'>]+)""", 1
    )


def _matches(token: Column, tag: Column, step: str) -> Column:
    if step == "*":
        return F.lit(True)
    name, _, css_class = step.partition(".")
    tests = []
    if name:
        tests.append(tag == name)
    if css_class:
        word = re.escape(css_class)
        tests.append(
            token.rlike(
                rf"""(?is)\sclass\s*=\s*(?:"(?:[^"]*\s)?{word}(?:\s[^"]*)?"|'(?:[^']*\s)?{word}(?:\s[^']*)?'|{word}(?=[\s/>]))"""
            )
        )
    result = tests[0]
    for test in tests[1:]:
        result = result & test
    return result


def _fold(tokens: Column, mark, mark_type: str, result_type: str, on_text, on_open) -> Column:
    """Walk the tokens with a stack of open elements (innermost first), each carrying a mark.

    ``mark(marks, token, tag)`` marks a new element, ``on_text(marks, found, token)`` and
    ``on_open(marks, found, token, tag)`` return the new ``found`` (and for tags also the new marks).
    """
    empty = F.struct(
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast(f"array<{mark_type}>").alias("marks"),
        F.lit(None).cast(result_type).alias("found"),
    )
    start = F.struct(
        F.coalesce(empty["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(empty["marks"], F.array().cast(f"array<{mark_type}>")).alias("marks"),
        F.coalesce(empty["found"], F.array().cast(result_type)).alias("found"),
    )

    def state(tags: Column, marks: Column, found: Column) -> Column:
        return F.struct(tags.alias("tags"), marks.alias("marks"), found.alias("found"))

    def drop(values: Column, count: Column) -> Column:
        return F.slice(values, count + 1, F.size(values))

    def step(acc: Column, token: Column) -> Column:
        tags, marks, found = acc["tags"], acc["marks"], acc["found"]
        tag = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        depth = F.array_position(tags, tag).cast("int")
        sibling = (tag.isin(_SELF_ENDING) & (F.try_element_at(tags, F.lit(1)) == tag)).cast("int")
        ended = F.coalesce(sibling, F.lit(0))
        outer_tags, outer_marks = drop(tags, ended), drop(marks, ended)
        opened_marks, opened_found = on_open(outer_marks, found, token, tag)
        empty_element = tag.isin(_VOID) | token.endswith("/>")
        return (
            F.when(~token.startswith("<"), state(tags, marks, on_text(marks, found, token)))
            .when(tag == "", acc)
            .when(token.startswith("</"), state(drop(tags, depth), drop(marks, depth), found))
            .when(empty_element, state(outer_tags, opened_marks, opened_found))
            .otherwise(
                state(
                    F.concat(F.array(tag), outer_tags),
                    F.concat(F.array(mark(outer_marks, token, tag)), opened_marks),
                    opened_found,
                )
            )
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


def element_texts(tokens: Column, selector: list[str]) -> Column:
    """Texts directly inside the selected elements: decoded, cleaned, empty ones dropped, in page order."""
    last = len(selector) - 1

    # An element's mark: twice the number of leading steps met by it and its parents, plus 1 if it is selected.
    def mark(marks: Column, token: Column, tag: Column) -> Column:
        met = F.coalesce(F.floor(F.try_element_at(marks, F.lit(1)) / 2).cast("int"), F.lit(0))
        picked = ((met == last) & _matches(token, tag, selector[last])).cast("int")
        grown = F.lit(0)
        for index in range(last):
            grown = F.when((met == index) & _matches(token, tag, selector[index]), F.lit(1)).otherwise(grown)
        return (met + grown) * 2 + picked

    def on_text(marks: Column, found: Column, token: Column) -> Column:
        return F.when(F.try_element_at(marks, F.lit(1)) % 2 == 1, F.concat(found, F.array(token))).otherwise(found)

    raw = _fold(tokens, mark, "int", "array<string>", on_text, lambda marks, found, token, tag: (marks, found))
    return F.filter(F.transform(raw, lambda text: clean_text(decode_entities(text))), lambda text: text.isNotNull())


def element_links(tokens: Column, container: str, cards: list[str], link: str, base: str) -> Column:
    """First link of every card inside a container, absolute, each address once, in page order."""
    inside, waiting, served = 1, 2, 3

    def any_of(token: Column, tag: Column) -> Column:
        result = _matches(token, tag, cards[0])
        for card in cards[1:]:
            result = result | _matches(token, tag, card)
        return result

    def mark(marks: Column, token: Column, tag: Column) -> Column:
        return (
            F.when((F.size(F.filter(marks, lambda m: m > 0)) > 0) & any_of(token, tag), F.lit(waiting))
            .when(_matches(token, tag, container), F.lit(inside))
            .otherwise(F.lit(0))
        )

    def on_open(marks: Column, found: Column, token: Column, tag: Column):
        hit = (
            F.array_contains(marks, waiting)
            & _matches(token, tag, link)
            & token.rlike(r"(?i)\shref\s*=")
        )
        href = decode_entities(_attribute(token, "href"))
        new_marks = F.when(hit, F.transform(marks, lambda m: F.when(m == waiting, F.lit(served)).otherwise(m)))
        new_found = F.when(hit & (href != ""), F.concat(found, F.array(href)))
        return F.coalesce(new_marks, marks), F.coalesce(new_found, found)

    hrefs = _fold(tokens, mark, "int", "array<string>", lambda marks, found, token: found, on_open)
    return F.array_distinct(F.transform(hrefs, lambda href: resolve_url(href, base)))


def decode_entities(text: Column) -> Column:
    """Replace numeric and HTML 4 named character references; unknown ones stay."""
    table = json.dumps({name: chr(code) for name, code in name2codepoint.items()}, ensure_ascii=False)
    names = F.from_json(F.lit(table), "map<string,string>")

    def character(entity: Column) -> Column:
        body = F.substring(entity, 2, 40)
        name = F.substring_index(body, ";", 1)
        digits = F.when(
            name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)
        ).otherwise(F.substring(name, 2, 8))
        code = digits.try_cast("int")
        usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return (
            F.when(
                name.startswith("#"),
                F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�")),
            ).otherwise(F.coalesce(F.try_element_at(names, name), entity))
        )

    parts = F.split(text, _ENTITY, -1)
    found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    rebuilt = F.array_join(
        F.zip_with(parts, F.transform(found, character), lambda part, char: F.concat(part, F.coalesce(char, F.lit("")))),
        "",
    )
    return F.when(text.contains("&"), rebuilt).otherwise(text)


def pair_map(titles: Column, values: Column) -> Column:
    """MAP title -> value by position; the shorter list decides, and of equal titles the last wins."""
    length = F.least(F.size(titles), F.size(values))
    pairs = F.arrays_zip(F.slice(titles, 1, length).alias("title"), F.slice(values, 1, length).alias("value"))
    places = F.transform(pairs, lambda pair, index: F.struct(pair["title"], pair["value"], index.alias("place")))
    last = F.filter(
        places,
        lambda entry: entry["place"]
        == F.array_max(
            F.transform(
                F.filter(places, lambda other: other["title"] == entry["title"]), lambda other: other["place"]
            )
        ),
    )
    return F.map_from_entries(F.transform(last, lambda entry: F.struct(entry["title"], entry["value"])))
