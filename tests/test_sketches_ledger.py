"""Sketches over batches, the replayable sink, rows scanned again."""

import random

import pytest

from msgscreen import route, scan
from msgscreen.operators import requeue as rq
from msgscreen.operators import sketches
from msgscreen.sources.ledger import BatchLedger
from msgscreen.sources.storage import shared_dir


def test_merged_figures_are_within_their_errors(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"text {rng.randrange(9000)}", f"s{rng.randrange(400)}", rng.randrange(500), rng.random() < 0.8) for _ in range(20_000)]
    rows += [("a", None, None, None, True)]
    df = spark.createDataFrame(rows, "source string, original_prompt string, session_id string, token_count int, allowed boolean").repartition(5)
    path = shared_dir(spark, "sketches")
    for part in df.randomSplit([1.0] * 4, seed=3):
        sketches.batch_sketches(part, "source").write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    once = {r.source: r for r in sketches.figures(sketches.merged(stored, "source"), "source").collect()}
    for source in "ab":
        own = [r for r in rows if r[0] == source]
        r = once[source]
        assert (r.n_messages, r.n_blocked) == (len(own), sum(not x[4] for x in own))
        assert r.distinct_texts == pytest.approx(len({x[1] for x in own if x[1]}), rel=sketches.DISTINCT_ERROR)
        assert r.distinct_sessions == pytest.approx(len({x[2] for x in own if x[2]}), rel=sketches.DISTINCT_ERROR)
        tokens = sorted(x[3] for x in own if x[3] is not None)
        for q, found in ((0.5, r.tokens_p50), (0.95, r.tokens_p95)):
            assert abs(sum(t <= found for t in tokens) / len(tokens) - q) < sketches.RANK_ERROR
    whole = sketches.figures(sketches.merged(sketches.merged(stored, "source"))).first()
    assert whole.n_messages == len(rows) and whole.distinct_texts == pytest.approx(len({x[1] for x in rows if x[1]}), rel=sketches.DISTINCT_ERROR)
    assert sketches.figures(sketches.merged(stored.limit(0), "source"), "source").count() == 0


@pytest.fixture()
def ledger(spark):
    return BatchLedger(spark, shared_dir(spark, "ledger"))


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def read(ledger):
    return sorted(r.n for r in ledger.read("n int").collect())


def test_a_stop_between_write_and_commit_loses_and_doubles_nothing(spark, ledger):
    assert ledger.write(0, numbers(spark, 1, 2)) and not ledger.write(0, numbers(spark, 9))
    commit = ledger._commit

    def stopped(batch, attempt):
        raise RuntimeError("stopped")

    ledger._commit = stopped
    for _ in range(2):
        with pytest.raises(RuntimeError):
            ledger.write(1, numbers(spark, 3))
    assert read(ledger) == [1, 2] and list(ledger.batches()) == ["0"]
    ledger._commit = commit
    assert ledger.write(1, numbers(spark, 3)) and read(ledger) == [1, 2, 3]
    assert ledger.sweep() == 2 and read(ledger) == [1, 2, 3]


def test_half_a_manifest_does_not_count(spark, ledger):
    fs, path = ledger._at("manifests/5")
    stream = fs.create(path, False)
    stream.write(b"abc")
    stream.close()
    assert read(ledger) == [] and ledger.write(5, numbers(spark, 7)) and read(ledger) == [7]


def test_two_attempts_at_once(spark, ledger):
    """Both write their rows before either commits: one of them counts."""
    numbers(spark, 1).write.parquet(f"{ledger.path}/data/3/a")
    numbers(spark, 1).write.parquet(f"{ledger.path}/data/3/b")
    assert [ledger._commit("3", "a"), ledger._commit("3", "b")] == [True, False]
    assert read(ledger) == [1] and ledger.sweep() == 1


def test_streamed_batches_into_the_ledger(spark, ledger, tmp_path):
    rows = [(str(i), f"mail u{i}@example.com") for i in range(12)]
    df = spark.createDataFrame(rows, "msg_id string, message string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shape = route(scan(df)).schema

    def run(checkpoint):
        keep = lambda batch, number: ledger.write(number, route(scan(batch)))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(shared_dir(spark, "checkpoint"))
    run(shared_dir(spark, "lost-checkpoint"))  # every batch comes a second time
    assert sorted(r.msg_id for r in ledger.read(shape).collect()) == sorted(i for i, _ in rows)


def test_rows_are_requeued_and_given_up(spark):
    def loader(fails):
        def load():
            def score(text):
                if any(f in text for f in fails):
                    raise RuntimeError("down")
                return 0.0

            return score

        return load

    df = spark.createDataFrame([("1", "fine"), ("2", "slow one"), ("3", "never")], "msg_id string, message string")
    scanned = scan(df, toxicity_model=loader(["slow", "never"]))
    assert [r.msg_id for r in rq.settled(scanned).collect()] == ["1"]
    queue = rq.to_requeue(scanned, ("msg_id",), max_attempts=2)
    assert sorted((r.msg_id, r.attempts, r.given_up, r.reason) for r in queue.collect()) == [(i, 1, False, "Scan failed: RuntimeError: down") for i in "23"]
    again = rq.rescan(queue, lambda m: scan(m, toxicity_model=loader(["never"])))
    assert [(r.msg_id, r.attempts, r.allowed) for r in rq.settled(again).collect()] == [("2", 1, True)]
    last = rq.to_requeue(again, ("msg_id",), max_attempts=2)
    assert [(r.msg_id, r.attempts, r.given_up) for r in last.collect()] == [("3", 2, True)]
    assert rq.rescan(last, scan).count() == 0
