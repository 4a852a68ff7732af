"""Metrics that add up over batches: distinct counts and quantiles as sketches of fixed size.

A batch is summed up once and stored; figures over any set of batches come from the
stored sketches alone. Stated errors: a distinct count is off by less than 5 % with
99.8 % likelihood (HyperLogLog, 2**12 registers); the rank of a quantile by less than
3 % of all rows with 99 % likelihood (KLL, k = 200).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTERS_LOG = 12
QUANTILE_K = 200
DISTINCT_ERROR = 0.05
RANK_ERROR = 0.03


def batch_sketches(scanned: DataFrame, *by: str, text: str = "original_prompt", session: str = "session_id") -> DataFrame:
    """``n_messages, n_blocked, texts, sessions, tokens`` per group; the last three are sketches, built on the map side."""
    return scanned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(~F.col("allowed")).alias("n_blocked"),
        F.hll_sketch_agg(text, REGISTERS_LOG).alias("texts"),
        F.hll_sketch_agg(session, REGISTERS_LOG).alias("sessions"),
        F.kll_sketch_agg_bigint(F.col("token_count").cast("bigint"), QUANTILE_K).alias("tokens"),
    )


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of several batches as one per group; merging again gives the same as merging at once."""
    return sketches.groupBy(*by).agg(
        F.sum("n_messages").alias("n_messages"),
        F.sum("n_blocked").alias("n_blocked"),
        F.hll_union_agg("texts").alias("texts"),
        F.hll_union_agg("sessions").alias("sessions"),
        F.kll_merge_agg_bigint("tokens").alias("tokens"),
    )


def figures(sketches: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Estimates: ``n_messages, n_blocked, distinct_texts, distinct_sessions`` and ``tokens_p50`` and the like."""
    return sketches.select(
        *by,
        "n_messages",
        "n_blocked",
        F.hll_sketch_estimate("texts").alias("distinct_texts"),
        F.hll_sketch_estimate("sessions").alias("distinct_sessions"),
        *(F.kll_sketch_get_quantile_bigint("tokens", F.lit(float(x))).alias(f"tokens_p{round(100 * x)}") for x in quantiles),
    )
