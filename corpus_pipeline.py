"""A training-data pipeline: each stage reads what the one before wrote, and its decisions take effect.

quality classifier -> exact dedup -> SimHash near-dedup -> secret scan -> packing.
All but the last stage return the columns of ``documents``. Every row is a document
of its own: a null id is an id like any other, and rows that repeat an id are decided
on one by one. A row is known by its place in the files of the stage before, so no
stage copies its input to number it; decisions travel as places, texts stay where
they are until the stage's result is written, and what a stage left in the shared
folder is deleted once the next one begins on the stored result.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from msgscreen.llm import exact_dedup, packing, quality, secrets, simhash  # noqa: E402
from msgscreen.llm.common import stored, table, with_place  # noqa: E402
from msgscreen.llm.queries import tokenizer_file  # noqa: E402
from msgscreen.sources.storage import release, scratch  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
left_behind: list[str] = []


def stage(work: Stage) -> Stage:
    """Release the scratch tables of earlier stages that ``docs`` does not read, and note down this one's."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, left_behind, needed_by=docs)
        left_behind.clear()
        with scratch() as own:
            found = work(spark, docs.select(*COLUMNS), sf_dir)
        left_behind.extend(own)
        return found

    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.rows_of_quality(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null one is smaller than any other."""
    rows = with_place(docs)
    gone = exact_dedup.exact_duplicates(rows.drop("at"), places=True).where("not kept").select("at")
    return rows.join(stored(gone, "exact-gone"), "at", "left_anti").select(*COLUMNS)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; a null one stays only where there is no other."""
    rows = with_place(docs)
    return rows.join(stored(simhash.near_copies(rows), "near-gone"), "at", "left_anti").select(*COLUMNS)


@stage
def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with all secrets found in it masked; ``n_chars`` counts the new text."""
    rows = with_place(docs)
    found = secrets.scan_secrets(rows, keep=("at",)).select("at", F.expr("sort_array(concat(base, added)) as spans"))
    marked = rows.join(stored(found.where("size(spans) > 0"), "secrets-found"), "at", "left")
    masked = F.when(F.col("spans").isNotNull(), secrets.redact("text", "spans")).otherwise(F.col("text"))
    n_chars = F.when(F.col("spans").isNotNull(), F.length("masked")).otherwise(F.col("n_chars"))
    marked = marked.withColumn("masked", masked).withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return marked.withColumn("text", F.col("masked")).select(*COLUMNS)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in training sequences."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("secret scans", masked_secrets),
    ("best-fit packing", packed_sequences),
]

# No SQL: the classifier and the tokenizer have no SQL form. tests/llm/test_pipeline.py has the filtering stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stored(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
