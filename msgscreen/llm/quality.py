"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in a fixed cycle; the trees of one
feature add up to a lookup table over its bins, those of a feature pair to a table
over two coarse bin axes. A score is the sum of one entry per table.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, stored

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "symbol", "space", "high", "distinct_words",
    "distinct_lines", "line_words", "stops", "capital_words", "symbol_words", "long_words", "bar_words", "letter_words",
)
KINDS = np.zeros(256, np.uint8)  # 0 lower-case letter, then the classes below
for _kind, _bytes in enumerate((range(65, 91), range(48, 58), b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\r\n\v\f", range(128, 256)), 1):
    KINDS[list(_bytes)] = _kind
SYMBOLS = re.compile(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]")


def features(text: bytes) -> list[float]:
    """Shape of one whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(text), len(words)
    kinds = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=7) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = [SYMBOLS.search(x) is not None for x in words] if kinds[4] else []
    return [
        math.log1p(n),
        math.log1p(w),
        n / w,
        *kinds[1:].tolist(),
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        math.log1p(w / len(lines)),
        sum(x[-1] in b".?!" for x in words) / w,
        sum(65 <= x[0] <= 90 for x in words) / w,
        sum(marks) / w,
        sum(map(len, words)) and sum(len(x) > 12 for x in words) / w,
        words.count(b"|") / w,
        sum(map(bytes.isalpha, words)) / w,
    ]


def with_features(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, x`` (the features as 8-byte floats) and ``kept``, a struct of the columns ``keep``; a null text counts as empty."""
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(features(t), np.float64).tobytes() for t in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["id", "x", "kept"])

    assert width == 18
    kept = F.struct(*(F.col(c) for c in keep) if keep else [F.lit(0).alias("_")]).alias("kept")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), kept)
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.BinaryType()), picked.schema["kept"]])
    return picked.mapInArrow(run, shape)


@dataclass
class Gam:
    """``intercept`` plus one lookup table per feature and per chosen pair of features."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j])]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a tree with a few leaves over the bins: split where the gain is largest, leaf by leaf."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for p, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = worth(lo, at) + worth(at, hi) - worth(lo, hi)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), (p, int(at[k]))), key=lambda b: b[0])
        if best[1] is None:
            break
        p, at = best[1]
        lo, hi = parts[p]
        parts[p : p + 1] = [(lo, at), (at, hi)]
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each of two axes."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = cg.shape[0] - 1, cg.shape[1] - 1
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    parts = []
    for c in (cg, ch):
        low = c[1:a, 1:b]
        parts.append((low, c[1:a, b:] - low, c[a:, 1:b] - low, c[a, b] - c[1:a, b:] - c[a:, 1:b] + low))
    gain = sum(x**2 / (y + ridge) for x, y in zip(*parts))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [float(x[i, j] / (y[i, j] + ridge)) for x, y in zip(*parts)]
    out = np.empty_like(g)
    i, j = i + 1, j + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return float(gain.max() - cg[a, b] ** 2 / (ch[a, b] + ridge)), out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 120, pair_rounds: int = 60,
    n_pairs: int = 6, leaves: int = 4, rate: float = 0.1, ridge: float = 5.0,
) -> Gam:
    """Cyclic boosting on the logistic loss: main tables first, then the pairs with the largest gain on what is left."""
    rate_of_ones = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = Gam(math.log(rate_of_ones / (1 - rate_of_ones)))
    if not len(y):
        return model
    width = x.shape[1]
    model.cuts = [quantile_cuts(x[:, j], bins) for j in range(width)]
    model.coarse = [quantile_cuts(x[:, j], coarse) for j in range(width)]
    at = [np.searchsorted(model.cuts[j], x[:, j]) for j in range(width)]
    size = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(n) for n in size]
    margin = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(at[j], g, size[j]), np.bincount(at[j], h, size[j]), leaves, ridge)
            model.tables[j] += step
            margin += step[at[j]]
    low = [np.searchsorted(model.coarse[j], x[:, j]) for j in range(width)]
    n_low = [len(c) + 1 for c in model.coarse]

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * n_low[j] + low[j], values, n_low[i] * n_low[j]).reshape(n_low[i], n_low[j])

    g, h = slopes()
    gains = {(i, j): quadrants(cells(i, j, g), cells(i, j, h), ridge)[0] for i, j in itertools.combinations(range(width), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.grids = [np.zeros((n_low[i], n_low[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for grid, (i, j) in zip(model.grids, model.pairs):
            g, h = slopes()
            step = rate * quadrants(cells(i, j, g), cells(i, j, h), ridge)[1]
            grid += step
            margin += step[low[i], low[j]]
    return model


def train(examples: DataFrame, max_train_rows: int = 50_000) -> Gam:
    """Fit on ``id, x, label``. At most ``max_train_rows`` rows, a hash sample over all of them, come to the driver."""
    picked = examples.where("label is not null").orderBy(F.xxhash64("id"), "id").limit(max_train_rows)
    rows = picked.select("x", "label").toArrow()
    x = np.array([np.frombuffer(b, np.float64) for b in rows["x"].to_pylist()]).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["label"].to_pylist(), np.float64))


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``id, label``, one row per id outside the held-out fold."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    return marks.where(~is_held_out(F.col("id"))).groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    max_train_rows: int = 50_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, held_out, score, predicted`` and the columns ``keep`` per row of ``docs``; labels of held-out ids are never read.

    Null and blank texts get the score of all-zero features; null ids are scored
    and take no part in training. Rows that repeat stay and score alike; of several
    labels of one id the mean, rounded up from a half, counts; null labels don't.
    Without any label all scores are one half. Of the other columns only ``keep``
    are read. An empty table gives an empty result.
    """
    scored = stored(with_features(docs, id_col, text_col, keep), "quality-features")
    marks = training_labels(labels, id_col, label_col)
    model = train(scored.join(marks, "id").groupBy("id", "x").agg(F.max("label").alias("label")), max_train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(b, np.float64) for b in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), batch.column(2)], ["id", "score", "kept"])

    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), scored.schema["kept"]])
    return scored.mapInArrow(run, shape).select(
        "id",
        is_held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *(F.col("kept")[c].alias(c) for c in keep),
    )


def quality_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 50_000
) -> Gam:
    """The model of ``quality_scores``, fitted without features of any but the chosen documents.

    The hash sample is drawn from the labelled ids of the table first, so at most
    ``max_train_rows`` ids are broadcast and no text is shuffled.
    """
    marks = training_labels(labels, id_col, label_col).where("label is not null")
    present = docs.select(F.col(id_col).cast("long").alias("id")).join(marks, "id").groupBy("id").agg(F.max("label").alias("label"))
    chosen = stored(present.orderBy(F.xxhash64("id"), "id").limit(max_train_rows), "quality-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    examples = with_features(texts, "id", "text", ("label",)).select("id", "x", "kept.label")
    return train(examples.groupBy("id", "x").agg(F.max("label").alias("label")), max_train_rows)


def rows_of_quality(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that the model does not reject, as they are: one pass, in which texts are neither stored nor shuffled."""
    columns = docs.columns
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = np.array([features(t) for t in bytes_of(batch.column(0))], np.float64).reshape(-1, len(FEATURES))
                good = pa.array(model.score(x) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(good)], ["kept"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["kept"]]))
    return found.select(*(F.col("kept").getField(c).alias(c) for c in columns))
