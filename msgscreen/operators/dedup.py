"""Result reuse: work once per distinct text, then hand the result to every copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """SHA-256 of the text, 32 bytes.

    Never null, so that joins on it add no null test; pushed below the
    projection, such a test would hash every text a second time.
    """
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(bytearray(b"")))


def per_distinct_text(
    df: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    text_col: str = "message",
    id_col: str = "msg_id",
    rows_per_salt: int = 500_000,
    stored_results: bool = False,
) -> DataFrame:
    """Apply ``work`` to the distinct texts and join its columns back to all rows.

    ``work`` gets a key column and ``text_col``; it may add columns, and must keep
    the key and every row. Rows carry only their key through the join, the text
    comes back from the distinct side. Copies are combined on the map side before
    the first shuffle, which also serves to find the hot texts. A hot text is
    spread over as many join keys as it has ``rows_per_salt`` copies, with its one
    result repeated for each. The small table of hot texts meets the rows by an
    ordinary join, whose hot side Spark can split. Where ``work`` stores its results
    (``stored_results``) the hot texts are read from there, and no text is shuffled again.
    """
    keyed = df.withColumn("_key", text_key(F.col(text_col)))
    distinct = keyed.groupBy("_key", text_col).agg(F.count(F.lit(1)).alias("_copies"))
    salted = distinct.select(
        "_key",
        text_col,
        F.when(F.col("_copies") > rows_per_salt, F.ceil(F.col("_copies") / rows_per_salt).cast("int"))
        .otherwise(F.lit(1))
        .alias("_salts"),
    )
    # Left to itself the engine merges partitions until they hold bytes enough, and the work on
    # them, which takes far longer than moving them, waits for the few largest tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results = work(salted.repartition(tasks, "_key"))
    sized = results if stored_results else salted
    hot = sized.where(F.col("_salts") > 1).select(F.col("_key").alias("_hot_key"), F.col("_salts").alias("_hot_salts"))
    one_per_salt = results.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    rows = keyed.drop(text_col).join(hot, F.col("_key") == F.col("_hot_key"), "left")
    rows = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(id_col), F.coalesce(F.col("_hot_salts"), F.lit(1))).cast("int")
    ).drop("_hot_key", "_hot_salts")
    joined = rows.join(one_per_salt.drop("_salts"), ["_key", "_salt"])
    added = [c for c in results.columns if c not in ("_key", "_salts", text_col) and c not in df.columns]
    return joined.select(*df.columns, *added)
