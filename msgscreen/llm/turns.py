"""Rows of conversations in a total order that holds across tasks, whatever share of them one conversation has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

HEAD = 100  # characters of a role or text that take part in the order before its digest does
ORDER = ("conv", "turn", "role_head", "text_head", "digest")
NO_CONVERSATION = "none"


def keyed_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, null_text: str) -> DataFrame:
    """``conv, turn, role, text`` and the keys that order them, ``role_head, text_head, digest``.

    ``conv`` is the decimal id, a null one ``none``. Null roles and texts become
    ``null_text``. Turns are ordered by number, null first; those of one number by
    the first characters of role and text, then by the digest of both, so that
    only equal rows are left without an order of their own.
    """
    picked = rows.select(
        F.coalesce(F.col(conv_col).cast("long").cast("string"), F.lit(NO_CONVERSATION)).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(null_text)).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(null_text)).alias("text"),
    )
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return picked.withColumns(
        {
            "role_head": F.substring("role", 1, HEAD),
            "text_head": F.substring("text", 1, HEAD),
            "digest": F.unhex(F.sha2(both.cast("binary"), 256)),
        }
    )


def conv_id() -> Column:
    """The id a ``conv`` key stands for."""
    return F.when(F.col("conv") != NO_CONVERSATION, F.expr("try_cast(conv as bigint)"))


def placed(light: DataFrame, purpose: str) -> DataFrame:
    """``light`` without its heads, with ``at``: a number that grows along the order of ORDER over the whole table.

    The order comes from a range partitioning, which cuts long conversations as it
    cuts anything else; numbers leave gaps between parts (``at >> 33`` is the part).
    """
    by = [F.col(c).asc_nulls_first() for c in ORDER]
    ordered = light.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.drop("role_head", "text_head").withColumn("at", F.monotonically_increasing_id()), purpose)
