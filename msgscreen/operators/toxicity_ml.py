"""Learned toxicity scores from Spark ML, saved and used as a stage of a scan on the JVM.

Two models: hashed words with logistic regression, and words of a fitted vocabulary
with naive Bayes, whose every weight can be read and recomputed from counts.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def train(documents: DataFrame, labels: DataFrame, features: int = 1 << 15, iterations: int = 10) -> PipelineModel:
    """Fit on the labelled documents; training aggregates gradients as a tree, never rows on the driver."""
    rows = documents.join(labels.select("doc_id", "toxic"), "doc_id").select(
        F.col("text"), F.col("toxic").cast("double").alias("label")
    )
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=fv.WORD_PATTERN, gaps=False),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
            LogisticRegression(maxIter=iterations, regParam=0.01, standardization=False),
        ]
    ).fit(rows)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """About a fifth of all documents, by a hash of their id."""
    return F.expr(f"cast(conv(substring(md5(cast({doc_id} as string)), 1, 2), 16, 10) as int) % 5 = 0")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, toxicity_score`` of every document by a model of the labelled ones not held out."""
    scored = train(documents, labels.where(~is_held_out())).transform(documents)
    return scored.select(
        "doc_id", is_held_out().alias("held_out"), vector_to_array("probability")[1].alias("toxicity_score")
    )


# ---------------------------------------------------------------------------
# A model as a stage of the scan
# ---------------------------------------------------------------------------
MODEL_TEXT = "_model_stage_text"
MODEL_COLUMNS = ("_model_stage_words", "_model_stage_features", "_model_stage_raw", "_model_stage_p", "_model_stage_class")


def word_evidence(rows: DataFrame, min_docs: int, min_evidence: float) -> DataFrame:
    """``word, evidence``: words whose share among the texts of class 1 differs from that among the others.

    ``rows`` holds ``text`` and ``label``. Evidence is the logarithm of the ratio of the
    two shares in standard deviations; words are counted once a text, on the map side.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(fv.WORD_PATTERN), F.lit(0))
    held = rows.select(F.col("label"), F.explode(F.array_distinct(words)).alias("word"))
    counts = held.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(f"a + b >= {min_docs}")
    totals = rows.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    n1, n0 = (totals.select(n).scalar() for n in ("n1", "n0"))
    ratio = F.log((F.col("a") + 1) / (n1 + 2)) - F.log((F.col("b") + 1) / (n0 + 2))
    evidence = F.abs(ratio) / F.sqrt(1 / (F.col("a") + 1) + 1 / (F.col("b") + 1))
    return counts.select("word", evidence.alias("evidence")).where(F.col("evidence") >= min_evidence)


def train_bayes(
    documents: DataFrame, labels: DataFrame, min_docs: int = 5, min_evidence: float = 3.0, vocabulary: int = 1 << 16, max_train_rows: int = 50_000
) -> PipelineModel:
    """Naive Bayes on which words of the vocabulary a text holds.

    The vocabulary are the words of ``min_docs`` labelled documents or more that tell
    the classes apart by ``min_evidence`` standard deviations; the driver gets these, the
    ``vocabulary`` strongest at most, and two weights for each. At most
    ``max_train_rows`` labels, a hash sample of all, are broadcast, so no text is
    shuffled. Documents without a text or a label take no part. Without any such word the score is the share of class 1.
    """
    labelled = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("double").alias("label"))
    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train_rows))
    rows = documents.where("text is not null").join(chosen, "doc_id").select("text", "label")
    strongest = word_evidence(rows, min_docs, min_evidence).orderBy(F.desc("evidence"), "word").limit(vocabulary)
    known = [r.word for r in strongest.collect()] or ["\x00"]
    words, features, raw, p, chosen = MODEL_COLUMNS
    held = CountVectorizerModel.from_vocabulary(known, inputCol=words, outputCol=features).setBinary(True)
    stages = [
        RegexTokenizer(inputCol=MODEL_TEXT, outputCol=words, pattern=fv.WORD_PATTERN, gaps=False),
        held,
        NaiveBayes(featuresCol=features, rawPredictionCol=raw, probabilityCol=p, predictionCol=chosen, modelType="multinomial", smoothing=1.0),
    ]
    return Pipeline(stages=stages).fit(rows.withColumnRenamed("text", MODEL_TEXT))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_model_score(df: DataFrame, text: str, model: PipelineModel, out: str) -> DataFrame:
    """Add the model's probability of class 1, null for a null text; a projection, for tables and streams alike.

    ``model`` reads ``MODEL_TEXT`` and gives its probability as the last column but one
    of ``MODEL_COLUMNS``, as that of ``train_bayes`` does.
    """
    scored = model.transform(df.withColumn(MODEL_TEXT, F.coalesce(F.col(text), F.lit(""))))
    p = F.when(F.col(text).isNotNull(), vector_to_array(MODEL_COLUMNS[3])[1])
    return scored.withColumn(out, p).select(*df.columns, out)
