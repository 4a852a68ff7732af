"""Running risk, gap sessions and threshold curves against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from msgscreen.operators import calibration, sessions
from msgscreen.sources.storage import shared_dir
from msgscreen.streaming.stream import stream_files

VERDICT = "msg_id string, session_id string, turn int, allowed boolean, violations array<struct<type:string,confidence:double,action:string>>"


def verdict(i, session, turn, blocked, rng):
    found = [("pii", 0.95, "anonymized")] if rng.random() < 0.3 else []
    if blocked:
        found.append(("secrets", rng.choice([0.6, 0.9, 1.0]), "blocked"))
    return (f"{i:06d}", session, turn, not blocked, found)


def risk_by_hand(rows):
    out, state = {}, {}
    for key, session, turn, allowed, found in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        if session is None:
            continue
        risk = max([c * (1.0 if a == "blocked" else 0.5) for _, c, a in found], default=0.0)
        top, blocked, streak = state.get(session, (0.0, 0, 0))
        streak = 0 if allowed else streak + 1
        state[session] = top, blocked, streak = max(top, risk), blocked + (not allowed), streak
        out[key] = (risk, top, blocked, streak, streak >= 2 or blocked >= 3)
    return out


@pytest.mark.parametrize("share", [0.05, 0.5, 1.0])
def test_running_risk_of_sessions_that_span_parts(spark, share):
    """A third of all rows is one session, which the order by range cuts into parts; turns repeat and may be null."""
    rng = random.Random(int(share * 100))
    rows = []
    for i in range(3000):
        session = rng.choice(["hot", "hot", *[f"s{j}" for j in range(30)], None]) if i % 3 else "hot"
        rows.append(verdict(i, session, rng.choice([None, *range(400)]), rng.random() < share, rng))
    df = spark.createDataFrame(rows, VERDICT).repartition(6)
    found = sessions.running_risk(df, "turn")
    got = {r.msg_id: (r.turn_risk, r.running_max, r.blocked_so_far, r.streak, r.escalated) for r in found.collect()}
    assert got == risk_by_hand(rows)
    assert df.limit(0).count() == sessions.running_risk(df.limit(0), "turn").count() == 0


def gaps_by_hand(rows, gap):
    out, last = [], {}
    for user, ts, allowed in sorted(rows, key=lambda r: (r[0], r[1])):
        if user in last and ts - last[user][1] <= gap:
            last[user][1:] = [ts, last[user][2] + 1, last[user][3] + (not allowed)]
        else:
            last[user] = [ts, ts, 1, int(not allowed)]
            out.append((user, last[user]))
    return sorted((u, s, e + gap, n, b) for u, (s, e, n, b) in out)


def test_gap_sessions_of_tables_and_streams(spark, tmp_path):
    rng, start, gap = random.Random(2), dt.datetime(2024, 1, 1), dt.timedelta(minutes=30)
    rows = [(f"u{rng.randrange(5)}", start + dt.timedelta(seconds=rng.randrange(6 * 3600)), rng.random() < 0.7) for _ in range(150)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, allowed boolean")
    listed = lambda d: sorted(tuple(r) for r in d.collect())
    want = gaps_by_hand(rows, gap)
    assert listed(sessions.gap_sessions(df, "user", "ts", "30 minutes")) == want

    source, out, checkpoint = str(tmp_path / "in"), shared_dir(spark, "sessions"), shared_dir(spark, "checkpoint")
    late = spark.createDataFrame([("u9", start + dt.timedelta(days=2), True)], df.schema)
    for part in (df.where("ts < '2024-01-01 03:00:00'"), df.where("ts >= '2024-01-01 03:00:00'"), late):
        part.coalesce(1).write.mode("append").parquet(source)
    arriving = stream_files(spark, source, df.schema, max_files_per_batch=1).withWatermark("ts", "4 hours")
    found = sessions.gap_sessions(arriving, "user", "ts", "30 minutes")
    query = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    assert listed(spark.read.schema(found.schema).parquet(out)) == want


def isotonic_by_hand(pairs):
    """Pool adjacent violators over ``bin, n, positives`` in order."""
    blocks = []
    for at, n, pos in pairs:
        blocks.append([[at], n, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {at: pos / n for ats, n, pos in blocks for at in ats}


def test_curve(spark):
    rng = random.Random(6)
    rows = [(s := round(rng.random(), 3), int(rng.random() < s)) for _ in range(2000)] + [(1.0, 1), (0.0, 0), (None, 1), (0.5, None)]
    curve = calibration.threshold_curve(spark.createDataFrame(rows, "score double, label int"), "score", "label", bins=20)
    known = [(s, y) for s, y in rows if s is not None and y is not None]
    bins = sorted({int(s * 20) for s, _ in known})
    pooled = isotonic_by_hand([(b, *(lambda ys: (len(ys), sum(ys)))([y for s, y in known if int(s * 20) == b])) for b in bins])
    got = {round(r.threshold * 20): r for r in curve.collect()}
    assert sorted(got) == bins
    for b, r in got.items():
        flagged = [y for s, y in known if int(s * 20) >= b]
        assert (r.flagged, r.true_positives) == (len(flagged), sum(flagged))
        assert r.precision == pytest.approx(sum(flagged) / len(flagged)) and r.recall == pytest.approx(sum(flagged) / sum(y for _, y in known))
        assert r.calibrated == pytest.approx(pooled[b])
    best = calibration.lowest_threshold(curve, 0.9)
    assert best is not None and all(r.precision >= 0.9 for b, r in got.items() if b / 20 >= best)
    assert calibration.lowest_threshold(curve, 1.1) is None


def test_curve_without_labels_or_positives(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert calibration.threshold_curve(none, "score", "label").count() == 0
    clean = spark.createDataFrame([(0.2, 0), (0.9, 0)], "score double, label int")
    assert [(r.precision, r.recall, r.calibrated) for r in calibration.threshold_curve(clean, "score", "label").orderBy("threshold").collect()] == [(0.0, None, 0.0)] * 2


def test_histogram_counts_on_the_map_side(spark):
    df = spark.range(10).select((F.col("id") / 10).alias("score"), (F.col("id") % 2).alias("label"))
    plan = calibration.score_histogram(df, "score", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2
