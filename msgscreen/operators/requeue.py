"""Rows whose scan failed, scanned again with a count of attempts, until they settle or are given up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import quarantined


def _failed(scanned: DataFrame) -> Column:
    failed = F.col("pii_scanner_error").isNotNull()
    return failed | F.col("scan_error").isNotNull() if "scan_error" in scanned.columns else failed


def settled(scanned: DataFrame) -> DataFrame:
    """Rows that every scanner dealt with, none of whose verdicts may change."""
    return scanned.where(~_failed(scanned))


def to_requeue(scanned: DataFrame, keys: tuple[str, ...], attempts: str = "attempts", max_attempts: int = 3) -> DataFrame:
    """Messages to scan again: their keys, ``message``, the attempts made, the last reason, and whether they are ``given_up``.

    Rows without a count have had one attempt. Those given up stay listed, on hold, for
    somebody to look at.
    """
    made = F.col(attempts) + 1 if attempts in scanned.columns else F.lit(1)
    rows = quarantined(scanned).withColumn(attempts, made.cast("int"))
    message = F.col("original_prompt").alias("message")
    return rows.select(*keys, message, attempts, "reason", (F.col(attempts) >= max_attempts).alias("given_up"))


def rescan(queue: DataFrame, scan: Callable[[DataFrame], DataFrame], attempts: str = "attempts") -> DataFrame:
    """Scan the queued messages that aren't given up; the attempts made so far travel along as a key column."""
    return scan(queue.where("not given_up").drop("given_up", "reason"))
