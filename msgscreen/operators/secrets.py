"""Credential detection; findings never change the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.patterns import find_all, holds_any, matches, quoted

# Literals of which every match holds at least one; texts without them skip the pattern.
_NEEDS = (("=", ":"), ("-",), ("_",), (), ("=", ":"), ("=", ":"), (), ("=", ":"))


def _has_secret(text: str, pattern_no: int) -> str:
    hit = matches(text, fv.SECRET_PATTERNS[pattern_no][1], ignore_case=True)
    needs = _NEEDS[pattern_no]
    return f"{holds_any(text, needs)} and {hit}" if needs else hit


def _per_pattern(text: str, item) -> Column:
    items = [
        f"case when {_has_secret(text, n)} then {item(n, name)} end" for n, (name, _) in enumerate(fv.SECRET_PATTERNS)
    ]
    return F.expr(f"array_compact(array({', '.join(items)}))")


def secret_matches(text: str, pattern_no: int) -> Column:
    """Whole matches of one pattern, for counting."""
    return F.expr(find_all(text, fv.SECRET_PATTERNS[pattern_no][1], ignore_case=True))


def secret_hits(text: str) -> Column:
    """``array<struct<pattern_no,type>>`` of the patterns that occur, in pattern order."""
    return _per_pattern(text, lambda n, name: f"named_struct('pattern_no', {n}, 'type', {quoted(name)})")


def secret_types(text: str) -> Column:
    """One type per pattern that occurs, in pattern order; a type may stand twice."""
    return _per_pattern(text, lambda n, name: quoted(name))


def extra_risk(text: str, rules: tuple[tuple[str, str, float], ...]) -> Column:
    """Highest risk of the caller's ``(name, pattern, risk)`` rules, 0 when none is given or hit."""
    risks = [f"if({matches(text, p, ignore_case=True)}, {float(w)}D, 0D)" for _, p, w in rules]
    return F.expr(f"array_max(array({', '.join(risks)}))" if risks else "0D")


def secret_verdict(types: str, risk: str) -> Column:
    """Combine found types with the risk of the extra rules."""
    return F.expr(
        f"""named_struct(
          'detected', size({types}) > 0 or {risk} > 0,
          'is_valid', not (size({types}) > 0 or {risk} > 0),
          'risk_score', if(size({types}) > 0, greatest({risk}, 1D), {risk}),
          'custom_secrets_types', {types})"""
    )
