"""Localized numbers and Vietnamese price texts."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import BILLION, BILLION_NAMES, MILLION
from .text import let

_GAP = r"[\s\x1C-\x1F]"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
BILLION_AMOUNT = rf"(?iU)({NUMBER}){_GAP}*{BILLION_NAMES}"
# fixed.MILLION_NAMES with its letter i as a class: case folding takes two more letters for an i, and so do the
# pattern engines that this has to agree with, but only there.
MILLION_AMOUNT = rf"(?iU)({NUMBER}){_GAP}*tr(?-i:[iIı])(?:ệu|eu)"
PER_M2 = "(?iu)/m[²2]"
# A lone separator between at most three and exactly three digits.
_GROUPED = r"^([0-9]{1,3})[.,]([0-9]{3})$"
# One last separator, after digits that hold at most separators of the other kind.
_DECIMAL = r"^(?:([0-9.]+),([0-9]+)|([0-9,]+)\.([0-9]+))$"
# Both kinds of separators still there: no number.
_MIXED = r"^.*(?:\..*,|,.*\.).*$"


@lru_cache(maxsize=1)
def _foreign_digits() -> tuple[str, str]:
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def number_token(text: Column) -> Column:
    """First run of digits with inner separators, '' when there is none."""
    return F.regexp_extract(text, NUMBER, 0)


def parse_token(token: Column) -> Column:
    """Value of one number token, NULL for ''.

    With both separators the later one is decimal; a lone separator groups thousands when it stands before
    exactly three digits and after at most three; a repeated separator always groups.
    """
    foreign, ascii_digits = _foreign_digits()

    def separated(plain: Column) -> Column:
        grouped = F.regexp_replace(plain, _GROUPED, "$1$2")
        marked = F.regexp_replace(grouped, _DECIMAL, "$1$3#$2$4")
        known = F.regexp_replace(marked, _MIXED, "")
        return F.translate(known, "#.,", ".").try_cast("double")

    def value(t: Column) -> Column:
        return (
            F.when(t == "", F.lit(None).cast("double"))
            .when(t.rlike("^[0-9]+$"), t.try_cast("double"))
            .when(t.rlike("[^0-9.,]"), separated(F.translate(t, foreign, ascii_digits)))
            .otherwise(separated(t))
        )

    return let(token, value)


def parse_number(text: Column) -> Column:
    """First number in a text as DOUBLE; a sign is not part of it."""
    return parse_token(number_token(text))


def half_even_int(number: Column) -> Column:
    return F.bround(number, 0).try_cast("int")


def parse_int(text: Column) -> Column:
    """First number in a text, rounded half to even."""
    return half_even_int(parse_number(text))


def parse_price(text: Column, area: Column) -> Column:
    """STRUCT(total, per_m2) in VND of a price text and an area.

    A whole price adds its billions and millions; a price per square metre takes its first unit only. The
    missing one of the two results follows from a positive area.
    """

    def amounts(t: Column) -> Column:
        return F.struct(
            (parse_token(F.regexp_extract(t, BILLION_AMOUNT, 1)) * F.lit(BILLION)).alias("billions"),
            (parse_token(F.regexp_extract(t, MILLION_AMOUNT, 1)) * F.lit(MILLION)).alias("millions"),
            t.rlike(BILLION_AMOUNT).alias("has_billions"),
            t.rlike(PER_M2).alias("is_rate"),
        )

    def stated(a: Column) -> Column:
        whole = F.coalesce(a["billions"], F.lit(0.0)) + F.coalesce(a["millions"], F.lit(0.0))
        return F.struct(
            F.when(~a["is_rate"] & (whole != 0), whole).alias("total"),
            F.when(a["is_rate"], F.when(a["has_billions"], a["billions"]).otherwise(a["millions"])).alias("rate"),
            F.when(area > 0, area).alias("area"),
        )

    def completed(s: Column) -> Column:
        return F.struct(
            F.coalesce(s["total"], s["rate"] * s["area"]).alias("total"),
            F.coalesce(s["rate"], s["total"] / s["area"]).alias("per_m2"),
        )

    return let(let(let(text, amounts), stated), completed)
