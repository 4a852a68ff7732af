"""What the operators share: stored intermediate tables, working column names, byte columns, link components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.storage import release, scratch, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there.

    Every executor and the driver see that folder, so a lost executor costs its
    running tasks only. The files belong to the job's scratch space.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(docs: DataFrame, purpose: str = "content") -> DataFrame:
    """``docs`` and ``at``, the file and row where each row lies: a unique key that takes no copy.

    Tables that aren't files are stored first.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    try:
        return docs.select(*docs.columns, place)
    except AnalysisException:
        return stored(docs, purpose).select(*docs.columns, place)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow column as bytes, null as empty."""
    as_binary = column.cast(pa.large_binary())
    return [x or b"" for x in as_binary.to_pylist()]


def matrix_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Equally long binary values of an Arrow column as a matrix, without a copy per row."""
    values = column.cast(pa.large_binary())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.empty((0, width), dtype)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(values), width)


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges (a, b)`` of longs.

    Contraction: each node moves to the smallest node near it, two steps a round,
    the edges are redrawn between the new places and loops and repeats dropped.
    Connected nodes stay connected, the smallest never moves, so each component
    ends in it. Rounds grow with the logarithm of the longest path. Group sizes
    never matter: minima and repeats combine before the shuffle, and in each join
    the side that may be skewed meets a side with unique keys, so that Spark can
    split it. Only nodes with an edge are returned; loops give no edge.
    """
    spark = edges.sparkSession
    with scratch() as begun:
        links = stored(edges.where("a <> b").select("a", "b").distinct(), f"{purpose}-edges")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("place", F.col("node"))
    for step in range(64):
        if links.isEmpty():
            return nodes.select("node", F.col("place").alias("component"))
        with scratch() as round_:
            both = links.select(F.explode(F.expr("array(struct(a as u, b as v), struct(b as u, a as v))")).alias("e"))
            near = both.select("e.*").groupBy("u").agg(F.min("v").alias("v"))
            near = near.select("u", F.least("u", "v").alias("p"))
            far = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            move = stored(near.join(far, "p").select("u", F.col("pp").alias("p")), f"{purpose}-move{step}")
            to_a = move.select(F.col("u").alias("a"), F.col("p").alias("pa"))
            to_b = move.select(F.col("u").alias("b"), F.col("p").alias("pb"))
            drawn = links.join(to_a, "a").join(to_b, "b").where("pa <> pb")
            links = stored(
                drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                f"{purpose}-links{step}",
            )
            there = move.select(F.col("u").alias("place"), F.col("p").alias("to"))
            nodes = stored(
                nodes.join(there, "place", "left").select("node", F.coalesce("to", "place").alias("place")),
                f"{purpose}-nodes{step}",
            )
        # The tables of the round before have been read for the last time.
        release(spark, begun)
        begun = round_
    raise RuntimeError("components did not settle in 64 rounds")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) of ``n`` numbered items over links ``a, b``, inside one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label
