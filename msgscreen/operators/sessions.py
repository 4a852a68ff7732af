"""Sessions in time: the risk a session has gathered turn by turn, and sessions by gaps between messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

ANONYMIZED_WEIGHT = 0.5


def message_risk() -> Column:
    """The highest confidence of the violations of a message; those that were only anonymized count half."""
    return F.expr(
        f"coalesce(array_max(transform(violations, v -> if(v.action = 'blocked', 1D, {ANONYMIZED_WEIGHT}D) * v.confidence)), 0D)"
    )


def running_risk(
    scanned: DataFrame, order: str, session: str = "session_id", key: str = "msg_id", streak: int = 2, blocked: int = 3
) -> DataFrame:
    """``key, session, order, turn_risk, running_max, blocked_so_far, streak, escalated`` per message of a session.

    ``streak`` counts the blocked messages in a row that end with this one; a message
    escalates its session when ``streak`` of them or ``blocked`` in all have come.
    Messages without a session are left out; equal places in ``order`` go by ``key``.

    Messages are put in order by range, so a session of any size is cut into parts
    like anything else. Running values are taken inside each part and the sums of the
    parts before, a row for each part a session touches, are carried in by a join.
    """
    light = scanned.where(F.col(session).isNotNull()).select(
        F.col(key).alias("k"), F.col(session).alias("s"), F.col(order).alias("o"), message_risk().alias("risk"), (~F.col("allowed")).cast("int").alias("b")
    )
    by = [F.col("s"), F.col("o").asc_nulls_first(), F.col("k").asc_nulls_first()]
    path = shared_dir(scanned.sparkSession, "session-order")
    ordered = light.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ordered.withColumn("part", F.shiftright("at", 33)).write.parquet(path)
    rows = scanned.sparkSession.read.parquet(path)

    so_far = Window.partitionBy("s", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("s", "part").orderBy("at")))
    rows = rows.withColumns(
        {
            "max_here": F.max("risk").over(so_far),
            "blocked_here": F.sum("b").over(so_far),
            "clean_here": F.max(F.when(F.col("b") == 0, F.col("pos"))).over(so_far),
        }
    )
    parts = rows.groupBy("s", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("risk").alias("m"), F.sum("b").alias("b"), F.max(F.when(F.col("b") == 0, F.col("pos"))).alias("clean")
    )
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = parts.select(
        "s",
        "part",
        "n_before",
        F.coalesce(F.max("m").over(before), F.lit(0.0)).alias("max_before"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("blocked_before"),
        F.coalesce(F.max(F.col("clean") + F.col("n_before")).over(before), F.lit(0)).alias("clean_before"),
    )
    found = rows.join(carried, ["s", "part"])
    total = F.col("blocked_here") + F.col("blocked_before")
    run = F.col("pos") + F.col("n_before") - F.greatest(F.coalesce(F.col("clean_here") + F.col("n_before"), F.lit(0)), "clean_before")
    return found.select(
        F.col("k").alias(key),
        F.col("s").alias(session),
        F.col("o").alias(order),
        F.col("risk").alias("turn_risk"),
        F.greatest("max_here", "max_before").alias("running_max"),
        total.cast("long").alias("blocked_so_far"),
        run.cast("long").alias("streak"),
        ((run >= streak) | (total >= blocked)).alias("escalated"),
    )


def gap_sessions(scanned: DataFrame, by: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """``by, session_start, session_end, n_messages, n_blocked``: messages of one sender without a longer gap between them.

    ``session_end`` is the time of the last message plus the gap. Works on tables and,
    given a watermark on ``time``, on streams in append mode: a session comes out once
    the watermark has passed its end. Messages of a sender combine on the map side if
    ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    window = F.session_window(time, gap)
    found = scanned.groupBy(by, window.alias("w")).agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(~F.col("allowed")).alias("n_blocked"))
    return found.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_messages", "n_blocked")
