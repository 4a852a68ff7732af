"""Exact dedup by a stateful stream: disk-backed keyed state, never expired, full bytes checked on hits.

Rows arrive as a stream of ``digest, identifier, content locator``. The state, kept
in RocksDB and checkpointed to the shared folder, holds one entry per digest: the
identifier and locator of the row that stays, and the number of rows. There is no
watermark, so nothing is ever forgotten. Digests with more than one row are hits:
the full bytes of each row are compared with those of the row that stays, and
digests under which different texts meet are split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.storage import shared_dir
from .common import ascii_lower, stored, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Many stores with little in each: room is taken as it is used, not in advance.
ALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, row_id: Column, text: Column, kept: Column) -> DataFrame:
    """``id, text, kept, at``: ``at`` is the file and row where a row's content lies; tables that aren't files are stored first."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    try:
        return docs.select(row_id.alias("id"), text.alias("text"), kept.alias("kept"), at)
    except AnalysisException:
        content = stored(docs.select(row_id.alias("id"), text.alias("text"), kept.alias("kept")), "dedup-content")
        return content.select("id", "text", "kept", at)


def keyed_state(arrivals: str, schema, spark, files_per_batch: int | None) -> DataFrame:
    """Run the stream over the arrivals to its end; ``digest, keeper, n`` of the state it leaves."""
    before = {PROVIDER: spark.conf.get(PROVIDER), ALLOCATE: spark.conf.get(ALLOCATE, "true")}
    out = shared_dir(spark, "dedup-state")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(arrivals).groupBy("digest").agg(F.max(F.struct("id", "at")).alias("keeper"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        # Overwriting makes a batch that runs again after a failure harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(ALLOCATE, "false")
    try:
        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", shared_dir(spark, "dedup-checkpoint"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        run.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    shape = "digest binary, keeper struct<id:bigint,at:struct<file:string,row:bigint>>, n bigint"
    updates = spark.read.schema(f"{shape}, batch int").parquet(out)
    # Each batch gives the new value of the digests it touched: the last one counts.
    last = updates.groupBy("digest").agg(F.max_by(F.struct("keeper", "n"), "batch").alias("s"))
    return last.select("digest", "s.keeper", "s.n")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    keep: tuple[str, ...] = (),
    places: bool = False,
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` and the columns ``keep`` per row; with ``places`` also ``at``.

    Texts are equal when identical after lower-casing A-Z.

    Of equal texts the row with the largest id stays; of rows that share that id,
    the one that lies last, so exactly one stays. A null text counts as empty. A
    null id is smaller than any other; its row stays only if its group has no other
    id. Of the other columns only ``keep`` are read, inside one struct. An empty table
    gives an empty result. ``digest`` may be weak: the check of the bytes makes up for it.
    """
    spark = docs.sparkSession
    kept = F.struct(*(F.col(c) for c in keep) if keep else [F.lit(0).alias("_")])
    rows = located(docs, F.col(id_col).cast("long"), F.col(text_col).cast("string"), kept)
    rows = rows.select("id", "at", ascii_lower(text_or_empty(F.col("text"))).alias("text"), "kept")
    keyed = rows.select("id", "at", "kept", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"))
    arrivals = shared_dir(spark, "dedup-arrivals")
    keyed.write.parquet(arrivals)
    keyed = spark.read.schema(keyed.schema).parquet(arrivals)
    if keyed.isEmpty():
        none = keyed.selectExpr("id", "id as keep_id", "0L as group_size", "true as kept", "lower(hex(sha)) as text_sha256", "kept as own", "at")
        also = ["at"] if places else []
        return none.select("id", "keep_id", "group_size", "kept", "text_sha256", *(F.col("own")[c].alias(c) for c in keep), *also)
    state = stored(keyed_state(arrivals, keyed.schema, spark, files_per_batch), "dedup-entries")

    # Hits: bring the bytes of these rows only, and compare each with those of the row that stays.
    hits = keyed.select("id", "at", "digest").join(state.where("n > 1").select("digest", "keeper"), "digest")
    hits = stored(hits.select("digest", "id", "at", F.col("keeper.at").alias("stays")), "dedup-hits")
    # Both sides are as large as the duplicates allow: always a shuffle, whatever a small table's size suggests.
    content = hits.select("at", "digest", "stays").hint("merge").join(rows.select("at", "text"), "at")
    content = stored(content, "dedup-bytes")
    kept_bytes = content.where("at = stays").select("digest", F.col("text").alias("kept_text"))
    differing = content.select("digest", "text").join(kept_bytes, "digest").where("text <> kept_text")
    # No distinct here: it would hold each digest's rows together and keep a hot one from being split.
    split = stored(differing.select("digest"), "dedup-collisions")

    # Different texts under one digest: the texts themselves are the key there.
    apart = content.join(split, "digest", "left_semi").select("at", "text").join(keyed.select("at", "id"), "at")
    by_text = apart.groupBy("text").agg(F.max(F.struct("id", "at")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    settled = apart.join(by_text, "text").select(F.col("at").alias("own_at"), F.struct("keeper", "n").alias("own"))
    found = keyed.join(state, "digest").join(settled, F.col("at") == F.col("own_at"), "left")
    keeper, n = F.coalesce("own.keeper", "keeper"), F.coalesce("own.n", "n")
    return found.select(
        "id",
        keeper["id"].alias("keep_id"),
        n.alias("group_size"),
        (F.col("at") == keeper["at"]).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(F.col("kept")[c].alias(c) for c in keep),
        *(["at"] if places else []),
    )
