"""Continuous screening with Structured Streaming.

The scan keeps no state, so a stream is the same projection as a batch: no
watermark, no state store, exactly-once through the file sink's log. What needs a
join with tables of any size runs batch by batch instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rollups import metric_columns
from ..operators.routing import route
from ..sources.messages import MESSAGE_SCHEMA


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType = MESSAGE_SCHEMA,
    format: str = "parquet",
    max_files_per_batch: int = 1000,
    **options,
) -> DataFrame:
    """New files below ``path`` as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_batch)
    return reader.options(**options).format(format).load(path)


def start_scan(
    messages: DataFrame,
    scan: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "10 seconds",
    tasks: int | None = None,
    per_batch: bool = False,
) -> StreamingQuery:
    """Scan a stream into parquet below ``path``, partitioned by route (hold / reply / forward).

    With ``per_batch`` every micro-batch is scanned as a table of its own, so that
    ``scan`` may join it with tables of any size (a large lexicon, a verdict store);
    its results lie below ``path/batch=<number>``, which a batch that runs again after
    a failure overwrites, so none is lost or doubled.

    Per-batch counts arrive as observed metrics named ``scan`` in the query
    progress, where a ``StreamingQueryListener`` can pick them up. ``tasks``
    spreads each batch, for sources that bring fewer file splits than there are
    cores; leave it out where batches hold many files.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    arriving = messages.repartition(tasks) if tasks else messages
    if per_batch:

        def keep(batch: DataFrame, number: int) -> None:
            scanned = scan(batch)
            counted = scanned.observe("scan", *metric_columns(scanned))
            route(counted).write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

        return arriving.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    scanned = scan(arriving)
    counted = scanned.observe("scan", *metric_columns(scanned))
    writer = (
        route(counted)
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("route")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**trigger).start()
