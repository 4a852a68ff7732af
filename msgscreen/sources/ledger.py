"""A sink that can be replayed: batches count once, from the moment a manifest names them.

Each attempt at a batch writes a folder of its own; the manifest of the batch, made
only if there is none yet, names the folder that counts. A job that stops between
the two leaves a folder nobody reads, and the same batch may simply be written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class BatchLedger:
    """Batches below ``path``: ``data/<batch>/<attempt>`` and ``manifests/<batch>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _attempt(self, batch: str) -> str | None:
        """The attempt that counts; a manifest without its last line was never finished and counts for nothing."""
        fs, path = self._at(f"manifests/{batch}")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return text.split("\n")[0] if text.endswith("\nend\n") else None

    def write(self, batch: int | str, rows: DataFrame) -> bool:
        """Write a batch unless it counts already; whether this attempt is the one that counts."""
        batch = str(batch)
        if self._attempt(batch):
            return False
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{batch}/{attempt}")
        return self._commit(batch, attempt)

    def _commit(self, batch: str, attempt: str) -> bool:
        fs, path = self._at(f"manifests/{batch}")
        if fs.exists(path) and self._attempt(batch) is None:
            fs.delete(path, False)  # half a manifest
        try:
            stream = fs.create(path, False)
        except Exception as taken:
            if "already exists" in str(taken):
                return False
            raise
        stream.write(f"{attempt}\nend\n".encode())
        stream.close()
        return True

    def batches(self) -> dict[str, str]:
        """Batches that count, with their attempts."""
        found = {b: self._attempt(b) for b in self._names("manifests")}
        return {b: a for b, a in found.items() if a}

    def read(self, schema: StructType) -> DataFrame:
        """The rows of all batches that count."""
        paths = [f"{self.path}/data/{b}/{a}" for b, a in self.batches().items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sweep(self) -> int:
        """Delete attempts that don't count, also of batches never finished; their number. Not while others write."""
        counted, gone = self.batches(), 0
        for batch in self._names("data"):
            for attempt in self._names(f"data/{batch}"):
                if counted.get(batch) != attempt:
                    fs, path = self._at(f"data/{batch}/{attempt}")
                    gone += bool(fs.delete(path, True))
        return gone
