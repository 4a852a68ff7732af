"""SimHash near-dedup: fingerprints and an exact, tiled search for close ones.

Fingerprints are cut into segments and put into tiles by the population counts of
the segments. Two fingerprints within ``radius`` bits differ by ``radius`` at most in
the summed difference of those counts, so only such tile pairs are compared, by
numpy exclusive-or and bit counts; all others are skipped. Nothing is missed.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, components, forest, stored

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SEGMENTS = 4  # of 16 bits: counts 0 to 16, hence 17**4 = 83,521 tile keys at most
DIGIT = 32  # base of a packed tile key; digits above 16 never occur, so a borrow can't meet a real key
PAIRS = 1 << 20  # comparisons done at once in a task


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bitwise majority of the XXH64 hashes of the word shingles of one text, 0 without words."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(run, 42) for run in runs], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` (signed 64-bit) of every row; a null text counts as empty."""
    return fingerprints(docs, F.col(id_col).cast("long"), text_col, width)


def fingerprints(docs: DataFrame, row: Column, text_col: str, width: int) -> DataFrame:
    """``id, fp`` per row, ``id`` being whatever ``row`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in bytes_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fp"])

    picked = docs.select(row.alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, T.StructType([picked.schema["id"], T.StructField("fp", T.LongType())]))


def neighbour_offsets(radius: int) -> list[int]:
    """Packed key differences of the later half of the tiles within ``radius``, the tile itself first."""
    near = [
        d
        for d in itertools.product(range(-radius, radius + 1), repeat=SEGMENTS)
        if sum(map(abs, d)) <= radius and d > (0,) * SEGMENTS
    ]
    return [0, *(sum(x * DIGIT**i for i, x in enumerate(reversed(d))) for d in near)]


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, the tile's own first: links between them and to the visiting ones.

    Per tile a task holds the tile's own rows (bounded) and one batch of visitors.
    Links within a tile shrink to its components, and a visitor is linked to one
    row of each component it meets: nothing grows with the pairs.
    """
    current, parts, label, own, ids = None, [], None, None, None

    def close(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, PAIRS // max(1, len(right)))
        for lo in range(0, len(left), step):
            near = np.bitwise_count(left[lo : lo + step, None] ^ right[None, :]) <= radius
            i, j = np.nonzero(near)
            yield i + lo, j

    def settle():
        nonlocal own, ids, label
        own = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([p[1] for p in parts])
        label = np.arange(len(own))
        for i, j in close(own, own):
            # one link for each row and component keeps what is carried on small
            pairs = np.unique(np.stack([label[i], label[j]], 1)[label[i] != label[j]], axis=0)
            label = forest(len(own), np.concatenate([pairs[:, 0], np.arange(len(own))]), np.concatenate([pairs[:, 1], label]))
        at = np.flatnonzero(label != np.arange(len(own)))
        return ids[label[at]], ids[at]

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        keys, subs, visits, prints, nodes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        prints = prints.view(np.uint64)
        if not len(keys):
            continue
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(subs) != 0)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if current != (keys[lo], subs[lo]):
                if own is None and parts:
                    yield out(*settle())
                current, parts, own = (keys[lo], subs[lo]), [], None
            first = lo + int(np.searchsorted(visits[lo:hi], 1))
            if first > lo:
                parts.append((prints[lo:first], nodes[lo:first]))
            if first == hi or not parts:
                continue
            if own is None:
                yield out(*settle())
            seen = [np.empty((0, 2), np.int64)]
            for i, j in close(own, prints[first:hi]):
                seen.append(np.unique(np.stack([label[i], j], 1), axis=0))
            met = np.unique(np.concatenate(seen), axis=0)
            yield out(ids[met[:, 0]], nodes[first:hi][met[:, 1]])
    if own is None and parts:
        yield out(*settle())


def close_pairs(prints: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """Links ``a, b`` that connect what is within ``radius`` bits; ``prints``: ``node, fp``, fingerprints distinct.

    A tile with more than ``tile_rows`` rows is cut by hash into several, each of
    which meets all others, so that no task gets a whole large one.
    """
    segment = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))
    key = sum((segment(i) * DIGIT**i for i in range(1, SEGMENTS)), segment(0))
    keyed = prints.select("node", "fp", key.cast("int").alias("key"))
    tiles = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    tiles = F.broadcast(tiles)  # bounded by the number of keys, see SEGMENTS
    own = keyed.join(tiles, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    near = F.array(*(F.lit(-x) for x in neighbour_offsets(radius)))
    meets = own.drop("tiles").select("*", F.explode(near).alias("by")).withColumn("tile", F.col("key") + F.col("by"))
    meets = meets.join(tiles.withColumnRenamed("key", "tile"), "tile")
    last = F.when(F.col("by") == 0, F.col("own")).otherwise(F.col("tiles") - 1)
    rows = meets.withColumn("sub", F.explode(F.sequence(F.lit(0), last)))
    visit = (~((F.col("by") == 0) & (F.col("sub") == F.col("own")))).cast("int")
    rows = rows.select("tile", "sub", visit.alias("visit"), "fp", "node")
    sorted_rows = rows.repartition("tile", "sub").sortWithinPartitions("tile", "sub", "visit")
    return sorted_rows.mapInArrow(lambda batches: compare(batches, radius), "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """``id, fingerprint, component_id, kept`` per row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other. Rows
    with a null id are returned with a fingerprint, a null component and ``kept``
    false, and link nothing. Rows that repeat an id stay, all with one component.
    Other columns of ``docs`` are not read, so their names can't clash. An empty
    table gives an empty result.
    """
    prints = stored(with_fingerprints(docs, id_col, text_col, width), "simhash-prints")
    distinct = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("first"))
    nodes = stored(distinct, "simhash-nodes")
    # Rows that share an id but not a fingerprint belong together.
    known = prints.where("id is not null").select("id", "fp")
    again = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = known.join(again, "id", "left_semi").distinct().join(nodes, "fp").select("id", "first")
    ties = repeats.join(repeats.groupBy("id").agg(F.min("first").alias("a")), "id")
    edges = close_pairs(nodes.select(F.col("first").alias("node"), "fp"), radius)
    grouped = components(edges.unionByName(ties.select("a", F.col("first").alias("b"))), "simhash")
    by_print = nodes.join(grouped, nodes["first"] == grouped["node"], "left").select(
        "fp", F.coalesce("component", "first").alias("component_id")
    )
    by_print = stored(by_print, "simhash-groups")
    found = prints.join(by_print, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return found.select(
        "id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``at`` of every row of ``docs`` (see ``with_place``) that is a near copy of another one, which stays.

    Rows are grouped by fingerprints alone, so null and repeated ids are rows like
    any other. Of each group the row with the smallest id stays, one without an id
    only where there is no other; equal ids go by place.
    """
    prints = stored(fingerprints(docs, F.struct(F.col(id_col).cast("long").alias("id"), "at"), text_col, width), "simhash-prints")
    nodes = stored(prints.select("fp").distinct(), "simhash-nodes")
    grouped = components(close_pairs(nodes.select(F.col("fp").alias("node"), "fp"), radius), "simhash")
    component = F.coalesce("component", "fp").alias("component")
    rows = prints.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select("id.id", "id.at", component)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at"))
    stays = rows.groupBy("component").agg(first.alias("first")).select("first.at")
    return rows.select("at").join(stays, "at", "left_anti")
