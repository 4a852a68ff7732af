"""Sinks for scan results and the shared folder that long jobs lean on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary
    folder, which no other machine has to see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="msgscreen-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The list of all shared folders handed out while the block runs, for a later ``release``."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield paths
    finally:
        _open_scopes.remove(paths)


def release(spark: SparkSession, paths: Iterable[str], needed_by: DataFrame | None = None) -> None:
    """Delete shared folders, but for those that a table still reads from.

    Only for tables whose readers have ended: plans are lazy, so an operator can't
    know when its own scratch tables are done with, but the job that stores its result can.
    """
    files = needed_by.inputFiles() if needed_by is not None else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            folder = hadoop.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_responses(scanned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Responses as parquet, partitioned by verdict so blocked traffic can be read alone."""
    scanned.write.mode(mode).partitionBy("allowed").parquet(path)


def write_routes(routed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The three destinations of a routed table in one pass over it."""
    routed.write.mode(mode).partitionBy("route").parquet(path)


def as_json(scanned: DataFrame) -> DataFrame:
    """``msg_id`` and the response contract as one JSON text, absent fields as null."""
    from ..plans.scan import RESPONSE_COLUMNS

    body = F.to_json(F.struct(*RESPONSE_COLUMNS), {"ignoreNullFields": "false"})
    return scanned.select("msg_id", body.alias("response"))
