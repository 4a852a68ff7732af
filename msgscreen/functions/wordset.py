"""A filter of fixed size for sets of words of any size, as literals of the plan."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 16


@dataclass(frozen=True)
class ChecksumFilter:
    """Two tables of 65,536 places, by the low and the high half of a word's checksum.

    A word whose places aren't both taken is not in the set; one whose are may be.
    Sets of more than some hundred thousand words fill the tables and filter less, but
    never wrongly.
    """

    low: bytes
    high: bytes

    @classmethod
    def of_places(cls, low: Iterable[int], high: Iterable[int]) -> ChecksumFilter:
        tables = []
        for places in (low, high):
            table = bytearray(PLACES)
            for at in places:
                table[at] = 1
            tables.append(bytes(table))
        return cls(*tables)

    @classmethod
    def of_words(cls, words: Iterable[str]) -> ChecksumFilter:
        sums = [zlib.crc32(w.encode()) for w in words]
        return cls.of_places({s & 0xFFFF for s in sums}, {s >> 16 for s in sums})

    @classmethod
    def of_column(cls, df: DataFrame, word: str) -> ChecksumFilter:
        """From a column of any length: the driver gets 65,536 numbers twice at most."""
        half = df.where(F.col(word).isNotNull()).select(F.crc32(F.col(word).cast("binary")).alias("s"))
        low = half.select((F.col("s") % PLACES).cast("int").alias("p")).distinct()
        high = half.select(F.shiftright("s", 16).cast("int").alias("p")).distinct()
        return cls.of_places(*([r.p for r in places.collect()] for places in (low, high)))

    def may_hold(self, word: Column) -> Column:
        total = F.crc32(word.cast("binary"))
        low, high = (total % PLACES + 1).cast("int"), F.shiftright(total, 16).cast("int") + 1
        taken = lambda table, at: F.substring(F.lit(table), at, 1) == F.lit(b"\x01")
        return taken(self.low, low) & taken(self.high, high)
