"""Texts that make patterns, stacks and folds suffer, through every query and the pipeline, each in bounded time."""

import random
import time

import pytest

import corpus_pipeline
from msgscreen.llm import queries

LONG = 2_000_000
SAID = 250_000  # characters of a turn; sampling segmentations of much longer ones takes minutes (see README)
SECONDS = 60  # eight cores; each takes well under 30 s alone


@pytest.fixture(scope="module")
def folder(spark, small_dir, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    hard = [
        " " * LONG, "a" * LONG, "\n" * LONG, "7" * LONG, "a1" * (LONG // 2), "\t \r\n" * (LONG // 4), "é中🙂" * (LONG // 4),
        "A1b2" * (LONG // 4), "password=" * (LONG // 9), ". " * (LONG // 2), "x\n" * (LONG // 2), prose(500_000), None, "",
    ]
    out = str(tmp_path_factory.mktemp("hard") / "in")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t or "")) for i, t in enumerate(hard)], docs.schema)
    docs.unionByName(extra).repartition(8).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    urls = [f"http://example.org/{'a/' * 20_000}", f"http://{'h' * LONG}/", f"x://h/{'1' * LONG}", "://", None]
    more = spark.createDataFrame([(10**6 + i, u, t) for (i, t), u in zip(enumerate(hard), urls)], pages.schema)
    pages.unionByName(more).repartition(8).write.parquet(f"{out}/pages.parquet")
    turns = spark.read.parquet(f"{small_dir}/conversations.parquet")
    said = spark.createDataFrame([(10**6 + i // 3, i, "user", t and t[:SAID]) for i, t in enumerate(hard)], turns.schema)
    turns.unionByName(said).repartition(8).write.parquet(f"{out}/conversations.parquet")
    for name in ("labels", "embeddings"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_query(spark, folder, name):
    start = time.perf_counter()
    n = queries.QUERIES[name](spark, folder).count()
    queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    assert n > 0 and (time.perf_counter() - start) / 2 < SECONDS


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        start = time.perf_counter()
        found = corpus_pipeline.stored(stage(spark, docs, folder), "hard")
        assert time.perf_counter() - start < SECONDS, name
        if name == corpus_pipeline.STAGES[0][0]:
            continue  # the classifier may reject what is no prose: the later stages get the hard texts all the same
        docs = docs if name == corpus_pipeline.STAGES[-1][0] else found
    assert found.count() > 0
