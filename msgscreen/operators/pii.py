"""Supplement recognisers: personal-data values by type, taken from the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.patterns import find_all, holds_any, matches, only_if

# Types in the order their values are reported and replaced.
SUPPLEMENT_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "PERSON")


def emails(text: str) -> Column:
    # Spares most rows the backtracking pattern.
    return F.expr(only_if(holds_any(text, "@"), find_all(text, fv.EMAIL_PATTERN)))


def has_digit(text: str) -> Column:
    return F.expr(matches(text, r"\d"))


def phones(text: str, digits: str | None = None) -> Column:
    """``digits`` names a column made by ``has_digit``, to share the test between recognisers."""
    # The pattern tries several optional parts at every word; most texts hold no digit at all.
    return F.expr(only_if(digits or matches(text, r"\d"), find_all(text, fv.PHONE_PATTERN)))


def ssns(text: str, digits: str | None = None) -> Column:
    found = find_all(text, fv.SSN_PATTERN)
    return F.expr(only_if(digits, found) if digits else found)


def cards(text: str, digits: str | None = None) -> Column:
    found = find_all(text, fv.CARD_PATTERN)
    return F.expr(only_if(digits, found) if digits else found)


def introduced_names(text: str) -> Column:
    """Names after an introduction phrase.

    The group always starts and ends with a letter and holds at least two, so
    no trimming or length check is left to do. Looking at the first letter of
    the phrases ahead of trying them changes no match and saves a third.
    """
    return F.expr(find_all(text, "(?=[mictn])" + fv.NAME_INTRO_PATTERN, group=1, ignore_case=True))


def greeted_names(text: str) -> Column:
    return F.expr(find_all(text, "(?=h)" + fv.NAME_GREETING_PATTERN, group=1, ignore_case=True))


def names(text: str) -> Column:
    return F.concat(introduced_names(text), greeted_names(text))


def supplement_values(text: str, digits: str | None = None) -> dict[str, Column]:
    """One array column per type, in report order."""
    found = (emails(text), phones(text, digits), ssns(text, digits), cards(text, digits), names(text))
    return dict(zip(SUPPLEMENT_TYPES, found))


def merge_values(primary: dict[str, Column], supplement: dict[str, Column]) -> dict[str, Column]:
    """Values per type: primary types first, supplement values appended to theirs."""
    merged = dict(primary)
    for name, values in supplement.items():
        merged[name] = F.concat(merged[name], values) if name in merged else values
    return merged


def values_by_type(merged: dict[str, Column]) -> Column:
    """Ordered ``array<struct<type,values>>`` of the types that have values.

    An array and not a map, because later replacement follows the type order.
    """
    entries = [F.struct(F.lit(t).alias("type"), v.alias("values")) for t, v in merged.items()]
    return F.filter(F.array(*entries), lambda e: F.size(e["values"]) > 0)
