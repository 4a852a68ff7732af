"""What a threshold costs: precision and recall per cut-off, and scores turned into probabilities."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_histogram(scored: DataFrame, score: str, label: str, bins: int = 100) -> DataFrame:
    """``bin, n, n_positive`` over labelled rows: scores in [0, 1] by bins of equal width, a score of 1 in a bin of its own."""
    usable = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = F.floor(F.col(score) * bins).cast("int").alias("bin")
    return usable.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("n_positive"))


def threshold_curve(scored: DataFrame, score: str, label: str, bins: int = 100) -> DataFrame:
    """``threshold, n, n_positive, flagged, true_positives, precision, recall, f1, calibrated`` per bin with rows.

    ``flagged`` and the figures after it are those of a cut-off at the lower end of the
    bin. ``calibrated`` is the share of positives of the bin after isotonic regression:
    neighbouring bins whose shares fall are pooled, so that a higher score never means
    a lower probability. Labels should be ones that no model was trained on. All rows are
    counted once, on the map side; what follows works on ``bins + 1`` rows at most.
    """
    spark = scored.sparkSession
    rows = score_histogram(scored, score, label, bins).collect()  # bins + 1 rows at most
    counts = spark.createDataFrame([(r.bin, r.n, r.n_positive) for r in rows], "bin int, n long, n_positive long")
    from_above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    curve = counts.withColumns({"flagged": F.sum("n").over(from_above), "true_positives": F.sum("n_positive").over(from_above)})
    total = sum(r.n_positive for r in rows)
    curve = curve.withColumns(
        {
            "precision": F.col("true_positives") / F.col("flagged"),
            "recall": F.col("true_positives") / F.lit(total) if total else F.lit(None).cast("double"),
            "f1": 2 * F.col("true_positives") / (F.col("flagged") + F.lit(total)),
        }
    )
    if rows:
        shares = counts.select((F.col("n_positive") / F.col("n")).alias("share"), F.col("bin").cast("double").alias("x"), F.col("n").cast("double").alias("w"), "bin")
        pooled = IsotonicRegression(featuresCol="x", labelCol="share", weightCol="w", predictionCol="calibrated").fit(shares).transform(shares)
        curve = curve.join(pooled.select("bin", "calibrated"), "bin")
    else:
        curve = curve.withColumn("calibrated", F.lit(None).cast("double"))
    return curve.select(
        (F.col("bin") / bins).alias("threshold"), "n", "n_positive", "flagged", "true_positives", "precision", "recall", "f1", "calibrated"
    )


def lowest_threshold(curve: DataFrame, min_precision: float) -> float | None:
    """The lowest cut-off from which on every higher one reaches the precision too; None if the highest doesn't."""
    best = None
    for r in sorted(curve.select("threshold", "precision").collect(), key=lambda r: -r.threshold):
        if r.precision < min_precision:
            break
        best = r.threshold
    return best
