"""Verdicts kept over runs, batches and failures."""

import pytest
from pyspark.sql import functions as F

from msgscreen import ScreenConfig, route, scan
from msgscreen.operators.reuse import VerdictStore, scan_reusing, version_of
from msgscreen.sources.storage import shared_dir
from msgscreen.streaming.stream import start_scan, stream_files

SHAPE = "msg_id string, message string"


def texts_of(n, start=0):
    return [f"mail u{i}@example.com" if i % 3 else f"password: hunter{i}" for i in range(start, start + n)]


def table(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], SHAPE).repartition(3)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def store(spark):
    return VerdictStore(spark, shared_dir(spark, "store"), buckets=4)


def stored_in(store, run):
    return store.spark.read.parquet(f"{store.path}/verdicts/{run}").count()


def test_second_run_scans_new_texts_only(spark, store):
    first, second = texts_of(100) * 2 + [None, " "], texts_of(90, 10) + texts_of(10, 500) * 3
    assert rows(scan_reusing(table(spark, first), store)) == rows(scan(table(spark, first)))
    assert rows(scan_reusing(table(spark, second), store)) == rows(scan(table(spark, second)))
    assert [stored_in(store, r) for r in store.runs()] == [100, 10]
    scan_reusing(table(spark, second), store).collect()
    assert stored_in(store, store.runs()[-1]) == 0


def test_bitmaps_keep_new_texts_out_of_the_join(spark, store):
    scan_reusing(table(spark, texts_of(200)), store)
    keyed = lambda texts: table(spark, texts).withColumn("_key", F.unhex(F.sha2("message", 256)))
    assert store.may_know(keyed(texts_of(200))).where("not _known").count() == 0
    assert store.may_know(keyed(texts_of(200, 1000))).where("_known").count() < 20


def test_other_rules_scan_again(spark, store):
    df = table(spark, ["Here's my key: sk-abc123xyz789", "fine"])
    assert [r.allowed for r in scan_reusing(df, store).orderBy("msg_id").collect()] == [False, True]
    assert all(r.allowed for r in scan_reusing(df, store, ScreenConfig(secret_rules=())).collect())
    assert [r.allowed for r in scan_reusing(df, store).orderBy("msg_id").collect()] == [False, True]
    lexicon = spark.createDataFrame([("fine", 0.9)], "word string, weight double")
    assert not any(r.allowed for r in scan_reusing(df, store, lexicon=lexicon).collect())
    assert version_of(ScreenConfig()) != version_of(ScreenConfig(), lexicon) != version_of(ScreenConfig(), lexicon.limit(0))


def test_equal_digests_of_other_texts_are_not_reused(spark, store):
    """A stored verdict under the digest of another text is ignored."""
    df = table(spark, ["fine"])
    forged = scan(table(spark, ["password: x1"])).drop("msg_id").withColumn("scan_error", F.lit(None).cast("string"))
    store.add(forged.withColumn("_key", F.unhex(F.sha2(F.lit("fine"), 256))), version_of(ScreenConfig()))
    assert scan_reusing(df, store).first().allowed


def test_run_without_manifest_does_not_count_and_is_swept(spark, store):
    df = table(spark, texts_of(20))
    scan_reusing(df, store).collect()
    commit, store._commit = store._commit, lambda change: (_ for _ in ()).throw(RuntimeError("stopped before the commit"))
    with pytest.raises(RuntimeError):
        scan_reusing(table(spark, texts_of(30)), store)
    store._commit = commit
    assert len(store.runs()) == 1 and len(store._names("verdicts")) == 2
    assert rows(scan_reusing(table(spark, texts_of(30)), store)) == rows(scan(table(spark, texts_of(30))))
    store.sweep()
    assert sorted(store._names("verdicts")) == sorted(store.runs()) and [stored_in(store, r) for r in store.runs()] == [20, 10]


def test_manifest_cut_short_is_passed_over(spark, store):
    scan_reusing(table(spark, texts_of(5)), store)
    stream = store._fs().create(store._hadoop.Path(f"{store.path}/manifests/000000007"), False)
    stream.write(b'{"buckets": 4, "ru')
    stream.close()
    assert len(store.runs()) == 1
    scan_reusing(table(spark, texts_of(9)), store)
    assert len(store.runs()) == 2


def test_compaction_keeps_results(spark, store):
    for n in (10, 20, 30):
        scan_reusing(table(spark, texts_of(n)), store).collect()
    store.add(store.verdicts(version_of(ScreenConfig())).drop("_version"), version_of(ScreenConfig()))  # every text twice
    store.compact()
    store.sweep()
    assert [stored_in(store, r) for r in store.runs()] == [30] and len(store._names("verdicts")) == 1
    assert rows(scan_reusing(table(spark, texts_of(35)), store)) == rows(scan(table(spark, texts_of(35))))
    assert stored_in(store, store.runs()[-1]) == 5


def test_failed_rows_are_tried_again(spark, store):
    def loader(bad):
        def load():
            def score(text):
                if bad:
                    raise RuntimeError("down")
                return 0.0

            return score

        return load

    df = table(spark, ["fine"])
    assert scan_reusing(df, store, toxicity_model=loader(True)).first().scan_error == "RuntimeError: down"
    assert scan_reusing(df, store, toxicity_model=loader(False)).first().allowed


def test_wrong_number_of_buckets(spark, store):
    scan_reusing(table(spark, ["x"]), store)
    with pytest.raises(ValueError, match="buckets"):
        VerdictStore(spark, store.path, buckets=8)


def test_over_long_messages_are_judged_but_not_kept(spark, store):
    config = ScreenConfig(max_message_chars=30)
    texts = texts_of(10) + ["x" * 31] * 5 + [f"{'word ' * 9}{i}" for i in range(5)]
    for _ in range(2):
        assert rows(scan_reusing(table(spark, texts), store, config)) == rows(scan(table(spark, texts), config))
    assert [stored_in(store, r) for r in store.runs()] == [10, 0]


def test_empty_input(spark, store):
    assert scan_reusing(table(spark, ["x"]).limit(0), store).count() == 0


def test_stream_with_copies_across_batches(spark, store, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    parts = [texts_of(30), texts_of(30, 10), texts_of(5) + [None]]
    for i, texts in enumerate(parts):
        df = spark.createDataFrame([(f"{i}-{j}", t) for j, t in enumerate(texts)], SHAPE)
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        arriving = stream_files(spark, source, df.schema, max_files_per_batch=1)
        start_scan(arriving, lambda b: scan_reusing(b, store), out, checkpoint, per_batch=True).awaitTermination()

    run()
    want = route(scan(spark.read.schema(df.schema).parquet(source)))
    got = spark.read.parquet(out)
    assert rows(got.select(want.columns)) == rows(want)
    assert sum(stored_in(store, r) for r in store.runs()) == 40
    run()  # nothing new: nothing lost, nothing doubled
    assert spark.read.parquet(out).count() == got.count()
