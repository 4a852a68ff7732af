"""Counts over scanned messages. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(scanned: DataFrame | None = None) -> list[Column]:
    """Batch metrics of a scan, usable in ``agg`` and in ``DataFrame.observe``.

    Given the table, rows on which a score model failed count as failed as well.
    """
    errors = ["pii_scanner_error"]
    if scanned is not None and "scan_error" in scanned.columns:
        errors.append("scan_error")
    counted = {
        "n_allowed": "allowed",
        "n_blocked": "not allowed",
        "n_token_limit": "array_contains(violations.type, 'token_limit')",
        "n_secrets": "array_contains(violations.type, 'secrets')",
        "n_pii": "array_contains(violations.type, 'pii')",
        "n_injection": "array_contains(violations.type, 'injection')",
        "n_toxicity": "array_contains(violations.type, 'toxicity')",
        "n_failed": " or ".join(f"{e} is not null" for e in errors),
    }
    return [
        F.expr("count(1) as n_messages"),
        *[F.expr(f"count_if({condition}) as {name}") for name, condition in counted.items()],
        F.expr("coalesce(sum(cast(token_count as bigint)), 0L) as n_tokens"),
    ]


def scan_metrics(scanned: DataFrame) -> DataFrame:
    return scanned.agg(*metric_columns(scanned))


def session_rollup(scanned: DataFrame, *by: str) -> DataFrame:
    """Messages and violations per group of the caller, sessions by default.

    The violation array is counted in place, so no row is multiplied.
    """
    keys = by or ("session_id",)
    return scanned.groupBy(*keys).agg(*metric_columns(scanned))


def violation_rollup(scanned: DataFrame, by: str) -> DataFrame:
    """Counts per ``(by, type)`` with subtotals per ``by`` (``level`` 1) and a grand total (``level`` 3)."""
    long = scanned.select(by, F.explode_outer("violations.type").alias("type")).where(F.col("type").isNotNull())
    # One row per (by, type) first: the rollup then multiplies groups, not rows.
    grouped = long.groupBy(by, "type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.rollup(by, "type").agg(F.grouping_id().alias("level"), F.sum("n").alias("n_violations"))
