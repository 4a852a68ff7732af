"""What happens to a message after its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import is_blank


def accepted(df: DataFrame, text_col: str = "message") -> DataFrame:
    return df.where(~is_blank(F.col(text_col)))


def rejected(df: DataFrame, text_col: str = "message") -> DataFrame:
    """Blank messages with the reason."""
    return df.where(is_blank(F.col(text_col))).withColumn("reason", F.lit(fv.EMPTY_MESSAGE_REASON))


def prompt_to_use(allowed: Column, anonymized: Column, original: Column) -> Column:
    """The redacted text where there is one, else the original; null when blocked."""
    return F.when(allowed, F.coalesce(F.nullif(anonymized, F.lit("")), original))


def route(scanned: DataFrame) -> DataFrame:
    """Add ``route`` (hold / reply / forward) and ``outgoing_prompt``.

    Rows whose scan failed are held whatever their verdict says. Written with
    ``partitionBy('route')`` the three sinks are filled in one pass.
    """
    failed = F.col("pii_scanner_error").isNotNull()
    if "scan_error" in scanned.columns:
        failed = failed | F.col("scan_error").isNotNull()
    blocked = ~F.col("allowed")
    return scanned.withColumns(
        {
            "route": F.when(failed, "hold").when(blocked, "reply").otherwise("forward"),
            "outgoing_prompt": F.when(failed, F.lit(None).cast("string"))
            .when(blocked, F.col("llm_handoff.prompt_for_llm"))
            .otherwise(prompt_to_use(F.lit(True), F.col("anonymized_prompt"), F.col("original_prompt"))),
        }
    )


def quarantined(scanned: DataFrame) -> DataFrame:
    """Rows that were not fully scanned, with the reason."""
    reason = F.col("pii_scanner_error")
    if "scan_error" in scanned.columns:
        reason = F.coalesce(F.concat(F.lit(fv.SCAN_FAILED_REASON), F.col("scan_error")), reason)
    return scanned.withColumn("reason", reason).where(F.col("reason").isNotNull())
