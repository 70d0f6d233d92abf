"""Text columns: whitespace, words and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and the ASCII separators U+001C..U+001F; (?U) makes \s one fast Unicode property test.
SPACE = r"(?U)[\s\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Keeps an expression that uses an intermediate value many times small: without it every use would repeat the
    whole computation, and pushed-down filters would repeat all of that again.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text: Column) -> Column:
    """Collapse white space to single blanks and trim; an empty result is NULL.

    Bound by ``let``, which also keeps a projection of many texts out of one fused method: the JVM only interprets
    methods of that size, split ones it compiles.
    """
    return let(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")), lambda cleaned: F.nullif(cleaned, F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_ngrams(tokens: Column) -> Column:
    """Single words followed by all pairs of neighbours."""
    firsts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    seconds = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.concat(tokens, F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b)))
