"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
import oracle
from msgscreen.plans import registered

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return oracle.connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small_dir, con, name):
    assert oracle.difference(QUERIES[name](spark, small_dir), con, SQL[name]) is None


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_query_of_the_engine_has_sql():
    assert set(registered.QUERIES) <= set(SQL)


def test_learned_model_tells_held_out_rows_apart(spark):
    sf_dir = "/root/testdata/sf0.1"
    scores = registered.toxicity_ml_scores(spark, sf_dir).where("held_out")
    labelled = scores.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("toxicity_score", "toxic").collect()
    toxic = [r.toxicity_score for r in labelled if r.toxic == 1]
    clean = [r.toxicity_score for r in labelled if r.toxic == 0]
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert len(toxic) > 20 and auc > 0.9


def test_entry_gives_one_row_per_usable_message(spark):
    df = contract.entry(spark)
    assert df.count() == 435
    assert "allowed" in df.columns
