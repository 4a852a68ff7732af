"""A saved model as a stage of the scan: held-out ranking, batch and stream, no Python worker."""

import pytest

from msgscreen import scan
from msgscreen.operators import toxicity_ml as ml
from msgscreen.plans import registered
from msgscreen.plans.scan import scan_wide
from msgscreen.sources.storage import shared_dir
from msgscreen.streaming.stream import start_scan, stream_files


@pytest.fixture(scope="module")
def model(spark):
    docs = [(i, "you utter trash person go away" if i % 3 == 0 else f"a nice day for thing{i % 5} and walks") for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)]
    fitted = ml.train_bayes(
        spark.createDataFrame([*docs, (99, None)], "doc_id long, text string"),
        spark.createDataFrame([*labels, (99, 1), (5, None)], "doc_id long, toxic int"),
    )
    path = shared_dir(spark, "model")
    ml.save(fitted, path)
    return ml.load(path)


def test_flags(messages, model):
    rows = scan_wide(messages("TRASH person!", "a nice walk", "unknown", "x" * 2001), toxicity_pipeline=model).orderBy("msg_id").collect()
    assert [r.has_toxicity for r in rows] == [True, False, False, False]
    assert rows[0].toxicity_score > 0.9 and rows[3].toxicity_score == 0.0 and rows[3].violations[0].type == "token_limit"


def test_columns_and_plan(messages, model):
    df = scan(messages("trash person"), toxicity_pipeline=model)
    assert df.columns == scan(messages("x")).columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_stream_equals_batch(spark, model, tmp_path):
    rows = [(str(i), "you trash person" if i % 2 else "a nice day") for i in range(20)]
    source, out = str(tmp_path / "in"), shared_dir(spark, "out")
    spark.createDataFrame(rows, "msg_id string, message string").write.parquet(source)
    df = spark.read.parquet(source)
    start_scan(stream_files(spark, source, df.schema), lambda m: scan(m, toxicity_pipeline=model), out, shared_dir(spark, "checkpoint")).awaitTermination()
    verdicts = lambda d: {(r.msg_id, r.allowed) for r in d.collect()}
    assert verdicts(spark.read.parquet(out)) == verdicts(scan(df, toxicity_pipeline=model)) == {(str(i), i % 2 == 0) for i in range(20)}


def test_held_out_ranking(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = ml.with_model_score(documents.where(ml.is_held_out()), "text", registered.stored_model(spark, sf_dir), "score")
    found = scored.join(labels, "doc_id").select("score", "toxic").collect()
    toxic, clean = ([r.score for r in found if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 20 and sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean)) > 0.9
