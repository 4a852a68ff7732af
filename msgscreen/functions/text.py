"""Sizing, labelling and blank checks as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def is_blank(text: Column) -> Column:
    """Null, empty or only whitespace; the extra range is whitespace to Python but not to Java."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def token_count(text: Column) -> Column:
    quarter = F.floor(F.length(text) / F.lit(fv.CHARS_PER_TOKEN)).cast("int")
    return F.greatest(F.lit(1), quarter)


def model_input(text: Column, chars: int = fv.MODEL_INPUT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def length_label(chars: Column) -> Column:
    return _label(fv.LENGTH_LABELS, lambda bound: chars < bound, fv.LENGTH_LABEL_REST)


def confidence_label(score: Column) -> Column:
    return _label(fv.CONFIDENCE_LABELS, lambda bound: score >= bound, fv.CONFIDENCE_LABEL_REST)


def _label(labels, applies, rest: str) -> Column:
    """The first label whose bound applies."""
    (bound, label), *more = labels
    out = F.when(applies(bound), label)
    for bound, label in more:
        out = out.when(applies(bound), label)
    return out.otherwise(rest)


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(text), F.lit(fv.WORD_PATTERN), F.lit(0)),
        F.array().cast("array<string>"),
    )
