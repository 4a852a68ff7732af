"""Verdicts kept over runs: texts scanned once are not scanned again, in this run or a later one.

A store is a folder of runs. Each run holds the responses of the texts it scanned
first, with their digests, and a bitmap of those digests; a run counts from the moment
a manifest names it, so one that stops halfway leaves nothing behind that is read.
Over-long messages are judged by their length alone and take no part. New texts meet
the bitmaps first: those that can't be known skip the join with the
stored verdicts. The others are known only if digest and text are equal and the
verdict was made under the same version of rules, models and thresholds.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..sources.storage import shared_dir
from .dedup import per_distinct_text

BITS = 8 * 4096  # of one bitmap
BROADCAST_BYTES = 16 << 20  # bitmaps beyond this size meet the texts in an ordinary join
WHOLE = "pii_scanner_error is null and scan_error is null"  # a scan that failed is kept for its caller only


class VerdictStore:
    """Stored responses below ``path``; ``buckets`` bitmaps of 4 KB tell which digests may be among them.

    The number of buckets is fixed when the store is made: ten bits or more a text keep
    nearly all new texts out of the join, fewer only cost time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        found = self._manifest()[1]
        if found and found["buckets"] != buckets:
            raise ValueError(f"the store has {found['buckets']} buckets, not {buckets}")

    # --- files ---------------------------------------------------------------
    def _fs(self):
        return self._hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._hadoop.Path(f"{self.path}/{folder}"), self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self) -> tuple[int, dict | None]:
        """Number and content of the newest manifest that was written to its end."""
        for name in reversed(self._names("manifests")):
            stream = self._fs().open(self._hadoop.Path(f"{self.path}/manifests/{name}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return int(name), json.loads(text)
        return 0, None

    def _commit(self, change: Callable[[list[str]], list[str]]) -> None:
        """Name the runs that count; a manifest of another job in between is taken into account."""
        for _ in range(100):
            number, found = self._manifest()
            number = max([number, *map(int, self._names("manifests"))]) + 1
            target = self._hadoop.Path(f"{self.path}/manifests/{number:09d}")
            try:
                stream = self._fs().create(target, False)
            except Exception as taken:
                if "already exists" in str(taken):
                    continue
                raise
            runs = change(found["runs"] if found else [])
            stream.write((json.dumps({"buckets": self.buckets, "runs": runs}) + "\n").encode())
            stream.close()
            return
        raise RuntimeError("no manifest could be written")

    def runs(self) -> list[str]:
        found = self._manifest()[1]
        return found["runs"] if found else []

    # --- tables --------------------------------------------------------------
    def _place(self, key: str = "_key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets * BITS)) + 1

    def verdicts(self, version: str) -> DataFrame | None:
        """Stored responses of a version with their ``_key``; the text is ``original_prompt``."""
        runs = self.runs()
        if not runs:
            return None
        return self.spark.read.parquet(*(f"{self.path}/verdicts/{r}" for r in runs)).where(F.col("_version") == version).where(WHOLE)

    def may_know(self, texts: DataFrame) -> DataFrame:
        """Add ``_known``: false for texts whose digest is surely not stored."""
        runs = self.runs()
        if not runs:
            return texts.withColumn("_known", F.lit(False))
        bitmaps = self.spark.read.parquet(*(f"{self.path}/bitmaps/{r}" for r in runs))
        bitmaps = bitmaps.groupBy("_bucket").agg(F.bitmap_or_agg("_bitmap").alias("_bitmap"))
        if self.buckets * BITS // 8 <= BROADCAST_BYTES:
            bitmaps = F.broadcast(bitmaps)
        placed = texts.withColumns({"_bucket": F.bitmap_bucket_number(self._place()), "_bit": F.bitmap_bit_position(self._place())})
        byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        known = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))
        return placed.join(bitmaps, "_bucket", "left").withColumn("_known", known).drop("_bucket", "_bit", "_bitmap")

    def add(self, responses: DataFrame, version: str) -> DataFrame:
        """Store the responses of new texts as a run of their own and read them back, failed ones included."""
        run = uuid.uuid4().hex
        return self._written(responses.withColumn("_version", F.lit(version)), run, lambda runs: [*runs, run])

    def _written(self, rows: DataFrame, run: str, change: Callable[[list[str]], list[str]]) -> DataFrame:
        rows.write.parquet(f"{self.path}/verdicts/{run}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/verdicts/{run}")
        placed = stored.where(WHOLE).select(self._place().alias("at")).select(
            F.bitmap_bucket_number("at").alias("_bucket"), F.bitmap_bit_position("at").alias("bit")
        )
        bitmaps = placed.groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bitmap"))
        bitmaps.write.parquet(f"{self.path}/bitmaps/{run}")
        self._commit(change)
        return stored

    def compact(self) -> None:
        """Make one run of all; of a text stored twice under one version, one verdict stays."""
        old = self.runs()
        if len(old) < 2:
            return
        run = uuid.uuid4().hex
        rows = self.spark.read.parquet(*(f"{self.path}/verdicts/{r}" for r in old)).where(WHOLE).drop("_salts")
        rows = rows.dropDuplicates(["_key", "original_prompt", "_version"])
        self._written(rows, run, lambda runs: [run, *(r for r in runs if r not in old)])

    def sweep(self) -> None:
        """Delete runs that no manifest names: replaced ones and those of jobs that failed. Not while others write."""
        current = set(self.runs())
        for folder in ("verdicts", "bitmaps"):
            for name in self._names(folder):
                if name not in current:
                    self._fs().delete(self._hadoop.Path(f"{self.path}/{folder}/{name}"), True)


def version_of(config: ScreenConfig, lexicon: DataFrame | None = None, models: str = "") -> str:
    """A name for the rules a verdict was made under; ``models`` is the caller's name for theirs."""
    words = ""
    if lexicon is not None:
        sums = lexicon.select(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(word, cast(weight as double)))").alias("x")).first()
        words = f"{sums.n}:{sums.x}"
    return hashlib.sha256(f"{config!r}|{words}|{models}".encode()).hexdigest()


def scan_reusing(
    df: DataFrame, store: VerdictStore, config: ScreenConfig = ScreenConfig(), lexicon: DataFrame | None = None, models_version: str = "", **models
) -> DataFrame:
    """The responses of ``scan``, with every text scanned only if the store doesn't know it; new ones are stored.

    Runs its jobs when it is called; the result reads the store's files and one scratch
    table. Texts whose scan failed are returned but never reused, so that the next run
    tries them again. A new version of ``models`` needs a new ``models_version``.
    """
    from ..plans.scan import RESPONSE_COLUMNS, decide, detect, error_columns, gate, scan_over_long, too_long
    from .routing import accepted

    keys = [c for c in df.columns if c != "message"]
    columns = [*RESPONSE_COLUMNS, *error_columns(models)]
    version = version_of(config, lexicon, models_version)

    def looked_up(texts: DataFrame) -> DataFrame:
        """The texts with their stored responses and ``_hit``. They lie by digest and text already, as the join asks."""
        stored = store.verdicts(version).select(F.col("_key").alias("_stored_key"), *columns).dropDuplicates(["_stored_key", "original_prompt"])
        same = (F.col("_key") == F.col("_stored_key")) & (F.col("message") == F.col("original_prompt"))
        marked = store.may_know(texts)
        met = marked.where("_known").join(stored, same, "left").withColumn("_hit", F.col("_stored_key").isNotNull())
        other = marked.where("not _known").withColumn("_hit", F.lit(False))
        looked = met.drop("_stored_key", "_known").unionByName(other.drop("_known"), allowMissingColumns=True)
        # Of a hit, the response holds the text.
        looked = looked.withColumn("message", F.expr("case when not _hit then message end"))
        path = shared_dir(store.spark, "reuse-looked-up")
        looked.write.parquet(path)
        return store.spark.read.schema(looked.schema).parquet(path)

    def work(texts: DataFrame) -> DataFrame:
        known, new = None, texts
        if store.runs():
            looked = looked_up(texts)
            known, new = looked.where("_hit"), looked.where("not _hit").select("_key", "_salts", "message")
        fresh = decide(detect(gate(new, config), config, lexicon, **models), config)
        fresh = store.add(fresh.select("_key", "_salts", *RESPONSE_COLUMNS, "scan_error"), version)
        results = fresh if known is None else known.select("_key", "_salts", *columns).unionByName(fresh.select("_key", "_salts", *columns))
        return results.select("_key", "_salts", F.col("original_prompt").alias("message"), *columns)

    rows = accepted(df)
    reused = per_distinct_text(rows.where(f"not ({too_long(config)})"), work, stored_results=True).select(*keys, *columns)
    return reused.unionByName(scan_over_long(rows, config, **models))
