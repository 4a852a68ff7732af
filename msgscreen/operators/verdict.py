"""Combining findings into one verdict per message, over the columns of ``plans.scan``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def _violation(when: str, type_: str, confidence: str, action: str) -> str:
    return (
        f"case when {when} then named_struct("
        f"'type', '{type_}', 'confidence', cast({confidence} as double), 'action', '{action}') end"
    )


def violations() -> Column:
    """Ordered violations; a message over the length gate has that one only.

    Reads ``too_long``, the four ``has_*`` flags, ``secrets``, ``injection_score``
    and ``toxicity_score``.
    """
    gated = _violation("too_long", "token_limit", f"{fv.TOKEN_LIMIT_CONFIDENCE}", "blocked")
    scanned = ", ".join(
        (
            _violation("has_secrets", "secrets", f"coalesce(secrets.risk_score, {fv.DEFAULT_SECRETS_SCORE})", "blocked"),
            _violation("has_pii", "pii", f"{fv.PII_CONFIDENCE}", "anonymized"),
            _violation("has_injection", "injection", f"coalesce(injection_score, {fv.DEFAULT_INJECTION_SCORE})", "blocked"),
            _violation("has_toxicity", "toxicity", f"coalesce(toxicity_score, {fv.DEFAULT_TOXICITY_SCORE})", "blocked"),
        )
    )
    return F.expr(f"array_compact(if(too_long, array({gated}), array({scanned})))")


def primary_violation(found: str) -> Column:
    """The first blocking violation, null when nothing blocks."""
    return F.expr(f"get(filter({found}, v -> v.action = 'blocked'), 0)")


def detected_threats(found: str) -> Column:
    return F.expr(f"transform({found}, v -> v.type)")


def risk_level(found: str) -> Column:
    """``SAFE`` without violations; no other level is published, so null."""
    return F.expr(f"case when size({found}) = 0 then '{fv.RISK_SAFE}' end")
