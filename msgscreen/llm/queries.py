"""The registered queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, exact_dedup, line_templates, packing, prefix_trie, quality, secrets, simhash, structure_repair, url_filter, warc
from . import sentencepiece_sampling as sampling
from .common import table

# Fixed values of the contract.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def tokenizer_file(name: str) -> str:
    """A vocabulary file by name; the folder can be set with TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), folder), folder)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.sampled_segmentations(
        table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", tokenizer_file("piece_bpe_32k.model")
    )
    ids = F.expr("array_join(ids, ',')")
    return found.select(
        F.split("key", ":")[0].cast("long").alias("conv_id"),
        F.split("key", ":")[1].cast("long").alias("turn"),
        "rank",
        F.size("ids").cast("long").alias("n_ids"),
        F.crc32(ids.cast("binary")).alias("ids_digest"),
        F.round("log_p", 6).alias("log_p"),
        F.round("inclusion", 6).alias("inclusion"),
        "round_trip",
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"), min_docs=2)
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer_file("byte_bpe_50k.json")
    ids = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return bpe.decoded(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("text")).alias("decoded_sha256"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    reports = structure_repair.conversation_reports(structure_repair.repaired(structure_repair.damaged(conversations)))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(reports, ids["id"].eqNullSafe(reports["conv_id"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_urls": op3_urls,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_embeddings": op6_embeddings,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lines": op8_lines,
    "op9_packing": op9_packing,
    "op10_exact": op10_exact,
    "op11_trie": op11_trie,
    "op12_bpe": op12_bpe,
    "op13_repair": op13_repair,
    "pipeline": pipeline,
}

SQL = {
    "op10_exact": """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(x) as text_sha256
from t window w as (partition by x)""",
}
