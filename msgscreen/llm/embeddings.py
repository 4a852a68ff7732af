"""Embedding near-dedup by collision counting over one-dimensional projections.

Every vector is projected onto many random lines. Two vectors collide on a line if
their projections lie in one window centred on either; close vectors collide on most
lines. Pairs that collide on at least ``hits`` lines are verified by cosine. ``hits``
and the number of line pairs used to bring vectors together are computed so that a
pair right at the threshold is missed with a stated probability.

To meet at all, a pair must collide on both lines of one of several line pairs. Each
line pair is a grid of cells a few windows wide, sorted by Spark; a vector visits the
neighbouring cells that its windows reach into.

Collisions are counted twice. First on the projections alone, 32 bytes a vector and
visit, to learn which vectors have a candidate in which tile; then those vectors, and
no others, come to that tile as a whole, and their pairs are verified there. A pair
belongs to the first grid that brings it together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forest, matrix_of, stored

UNIT = 16  # window half-width in quantisation steps; projections are compared as wrapped 8-bit numbers
BLOCK = 1 << 20  # pairs looked at at once in a task
TILE = ("width", "grid", "x", "y", "tile")


def binomial_tail(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


@dataclass(frozen=True)
class Plan:
    """Lines, windows and counts for a cosine threshold."""

    lines: int
    grids: int
    hits: int
    window: float
    recall: float

    @staticmethod
    def calibrated(threshold: float, lines: int = 32, window: float = 0.4, missed: float = 0.001) -> Plan:
        """Most hits and fewest grids that miss a pair at the threshold with probability ``missed`` each at most.

        The projections of unit vectors at cosine c differ by a normal number of
        deviation sqrt(2 - 2c). One quantisation step is taken off the window.
        """
        reach = window * (UNIT - 1) / UNIT
        p = math.erf(reach / math.sqrt(2 - 2 * threshold) / math.sqrt(2))
        grids = min(lines // 2, math.ceil(math.log(missed) / math.log(1 - p * p)))
        hits = max(k for k in range(lines + 1) if binomial_tail(lines, p, k) >= 1 - missed)
        return Plan(lines, grids, hits, window, (1 - (1 - p * p) ** grids) * binomial_tail(lines, p, hits))


def projected(vectors: DataFrame, plan: Plan, seed: int, single: bool) -> DataFrame:
    """``id, digest, width, q`` (steps on the grids' lines), ``low`` (all lines, wrapped to a byte), ``v`` (as given).

    ``v`` holds 32-bit numbers if the column does (``single``), which loses nothing.
    Rows without an id and vectors that are null, empty, zero or hold null or non-finite
    components keep their id only. Equal vectors have equal digests (BLAKE2, 128 bits),
    zeros of either sign being equal.
    """
    number = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = {}
        for batch in batches:
            out = []
            for id_, values in zip(*(batch.column(i).to_pylist() for i in range(2))):
                raw = np.array(values, number) + number(0) if id_ is not None and values and None not in values else np.zeros(1)
                if not np.isfinite(raw).all() or not raw.any():
                    out.append((id_, None, None, None, None, None))
                    continue
                n = len(raw)
                if n not in lines:
                    lines[n] = np.random.default_rng([seed, n]).standard_normal((n, plan.lines))
                steps = np.floor(units(raw[None])[0] @ lines[n] * (UNIT / plan.window)).astype(np.int64)
                held = raw.tobytes()
                digest = hashlib.blake2b(held, digest_size=16).digest()
                out.append((id_, digest, n, steps[: 2 * plan.grids].astype(np.int32), (steps & 255).astype(np.uint8).tobytes(), held))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in out], kind)
                    for i, kind in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()))
                ],
                ["id", "digest", "width", "q", "low", "v"],
            )

    return vectors.mapInArrow(run, "id long, digest binary, width int, q array<int>, low binary, v binary")


def units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in doubles; scaled by their largest component first, so that no square overflows."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def placed(points: DataFrame, plan: Plan, cell_windows: int, tile_rows: int) -> DataFrame:
    """Each point in its own cell of every grid, and as a visitor of the later half of the cells around it.

    A pair in two cells meets in one of them only. A cell with more than
    ``tile_rows`` points is cut by hash into tiles, all of which meet.
    """
    cell = cell_windows * UNIT
    by_grid = F.expr(
        f"explode(transform(sequence(0, {plan.grids - 1}), g -> named_struct('grid', g, 'x', q[2 * g], 'y', q[2 * g + 1])))"
    )
    at = points.select("node", "width", "low", by_grid.alias("p")).selectExpr(
        "node", "width", "low", "p.grid as grid",
        f"cast(floor(p.x / {cell}) as int) as cx", f"cast(floor(p.y / {cell}) as int) as cy",
        f"cast(pmod(p.x, {cell}) as int) as dx", f"cast(pmod(p.y, {cell}) as int) as dy",
    )
    low, high = f"< {UNIT}", f">= {cell - UNIT}"
    visits = F.expr(
        f"""array_compact(array(named_struct('by', 0, 'x', cx, 'y', cy),
          case when dx {low} then named_struct('by', 1, 'x', cx - 1, 'y', cy) end,
          case when dx {low} and dy {low} then named_struct('by', 2, 'x', cx - 1, 'y', cy - 1) end,
          case when dx {low} and dy {high} then named_struct('by', 3, 'x', cx - 1, 'y', cy + 1) end,
          case when dy {low} then named_struct('by', 4, 'x', cx, 'y', cy - 1) end))"""
    )
    crowded = at.groupBy("width", "grid", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    crowded = stored(crowded.where("tiles > 1"), "embeddings-crowded").toDF("width", "grid", "x", "y", "tiles")
    rows = at.select("node", "width", "low", "grid", F.explode(visits).alias("to")).select(
        "node", "width", "low", "grid", "to.by", "to.x", "to.y"
    )
    rows = rows.join(crowded, ["width", "grid", "x", "y"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    last = F.when(F.col("by") == 0, own).otherwise(F.col("tiles") - 1)
    rows = rows.withColumn("own", own).withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    visit = (~((F.col("by") == 0) & (F.col("own") == F.col("tile")))).cast("int")
    return rows.select(*TILE, visit.alias("visit"), "node", "low")


def by_tile(rows: DataFrame) -> DataFrame:
    """All rows of a tile in one task, its own points first."""
    return rows.repartition(*TILE).sortWithinPartitions(*TILE, "visit")


class Tiles:
    """Rows of sorted tiles: each tile's own points (bounded), then its visitors batch by batch.

    Both sides lie along the grid's first line; ``x`` counts its steps from one window before the cell.
    """

    def __init__(self, plan: Plan, cell_windows: int):
        self.plan, self.cell = plan, cell_windows * UNIT

    def along(self, tile: tuple, side: dict) -> dict:
        x = side["low"][:, 2 * tile[1]] - np.uint8((tile[2] * self.cell - UNIT) & 255)
        order = np.argsort(x, kind="stable")
        return {k: v[order] for k, v in side.items()} | {"x": x[order].astype(np.int16)}

    def walk(self, batches: Iterator[pa.RecordBatch], columns) -> Iterator[tuple[tuple, dict, dict | None]]:
        """``tile, own, None`` once a tile and then ``tile, own, visitors`` for each batch of these.

        ``columns`` makes arrays from a slice of a batch and its vectors' width.
        """
        current, parts, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], 1)
            visit = batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                tile = tuple(keys[lo].tolist())
                if current != tile:
                    if own is None and parts:
                        yield current, self.along(current, joined(parts)), None
                    current, parts, own = tile, [], None
                part = columns(batch.slice(lo, hi - lo), tile[0])
                first = int(np.searchsorted(visit[lo:hi], 1))
                if first:
                    parts.append({k: v[:first] for k, v in part.items()})
                if first == hi - lo or not parts:
                    continue
                if own is None:
                    own = self.along(current, joined(parts))
                    yield current, own, None
                yield current, own, self.along(current, {k: v[first:] for k, v in part.items()})
        if own is None and parts:
            yield current, self.along(current, joined(parts)), None

    def candidates(self, tile: tuple, left: dict, right: dict | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that collide often enough and that no earlier grid brings together; each pair of one side once."""
        among, right, grid = right is None, left if right is None else right, tile[1]
        step = max(1, min(256, BLOCK // max(1, len(right["node"]))))
        span, dims = np.uint8(2 * UNIT), 2 * self.plan.grids
        for lo in range(0, len(left["node"]), step):
            ours, x = left["low"][lo : lo + step], left["x"][lo : lo + step]
            start = int(np.searchsorted(right["x"], x[0] - UNIT))
            if among:
                start = max(start, lo + 1)
            theirs = right["low"][start : int(np.searchsorted(right["x"], x[-1] + UNIT, side="right"))]
            if not len(theirs):
                continue
            columns = np.ascontiguousarray(theirs.T)
            count = np.zeros((len(ours), len(theirs)), np.uint8)
            for k in range(self.plan.lines):
                count += ours[:, k, None] + np.uint8(UNIT) - columns[k] <= span
            i, j = np.nonzero(count >= self.plan.hits)
            i, j = i + lo, j + start
            if among:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                apart = left["low"][a, :dims] + np.uint8(UNIT) - right["low"][b, :dims] > span
                met = ~(apart[:, 0::2] | apart[:, 1::2])
                here = met[:, grid] & ~met[:, :grid].any(axis=1)
                if here.any():
                    yield a[here], b[here]


def joined(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def involved(batches: Iterator[pa.RecordBatch], plan: Plan, cell_windows: int) -> Iterator[pa.RecordBatch]:
    """Of each tile, the points and visitors that have a candidate there, by projections alone."""
    tiles = Tiles(plan, cell_windows)

    def columns(rows, width):
        return {"node": numbers(rows.column(6)), "low": matrix_of(rows.column(7), np.uint8, plan.lines)}

    def out(tile, side, marked, visit):
        at = np.flatnonzero(marked)
        key = [pa.array(np.full(len(at), k), pa.int32()) for k in tile]
        return pa.RecordBatch.from_arrays(
            [*key, pa.array(np.full(len(at), visit), pa.int32()), pa.array(side["node"][at], pa.int64())], [*TILE, "visit", "node"]
        )

    tile = own = marked = None
    for at, points, visitors in tiles.walk(batches, columns):
        if own is not points:
            if own is not None:
                yield out(tile, own, marked, 0)
            tile, own, marked = at, points, np.zeros(len(points["node"]), bool)
        guests = None if visitors is None else np.zeros(len(visitors["node"]), bool)
        for i, j in tiles.candidates(tile, own, visitors):
            marked[i] = True
            (marked if guests is None else guests)[j] = True
        if guests is not None:
            yield out(tile, visitors, guests, 1)
    if own is not None:
        yield out(tile, own, marked, 0)


def verified(batches: Iterator[pa.RecordBatch], plan: Plan, threshold: float, cell_windows: int, single: bool) -> Iterator[pa.RecordBatch]:
    """``a, b`` of links that connect, and ``a, n`` of link counts; dense groups are counted, not listed."""
    tiles, kind = Tiles(plan, cell_windows), np.float32 if single else np.float64

    def columns(rows, width):
        return {
            "node": numbers(rows.column(6)),
            "weight": numbers(rows.column(7)),
            "low": matrix_of(rows.column(8), np.uint8, plan.lines),
            "v": units(matrix_of(rows.column(9), kind, width)),
        }

    def out(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def counts(side, links):
        at = np.flatnonzero(links)
        return out(side["node"][at], np.full(len(at), -1), links[at].astype(np.int64))

    def links_of(tile, left, right):
        for i, j in tiles.candidates(tile, left, right):
            close = np.einsum("ij,ij->i", left["v"][i], (left if right is None else right)["v"][j]) >= threshold
            yield i[close], j[close]

    label = None
    for tile, own, visitors in tiles.walk(batches, columns):
        size = len(own["node"])
        ours = np.zeros(size)
        if visitors is None:
            label = np.arange(size)
            for i, j in links_of(tile, own, None):
                ours += np.bincount(i, own["weight"][j], size) + np.bincount(j, own["weight"][i], size)
                apart = label[i] != label[j]
                pairs = np.unique(np.stack([label[i], label[j]], 1)[apart], axis=0)
                if len(pairs):
                    label = forest(size, np.r_[pairs[:, 0], np.arange(size)], np.r_[pairs[:, 1], label])
            at = np.flatnonzero(label != np.arange(size))
            yield out(own["node"][label[at]], own["node"][at], np.zeros(len(at)))
            yield counts(own, ours)
            continue
        theirs, seen = np.zeros(len(visitors["node"])), [np.empty((0, 2), np.int64)]
        for i, j in links_of(tile, own, visitors):
            ours += np.bincount(i, visitors["weight"][j], size)
            theirs += np.bincount(j, own["weight"][i], len(theirs))
            seen.append(np.unique(np.stack([label[i], j], 1), axis=0))
        met = np.unique(np.concatenate(seen), axis=0)
        yield out(own["node"][met[:, 0]], visitors["node"][met[:, 1]], np.zeros(len(met)))
        yield counts(own, ours)
        yield counts(visitors, theirs)


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    plan: Plan | None = None,
    cell_windows: int = 2,
    tile_rows: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """``id, n_links, component_id, kept`` per row.

    Rows with equal vectors become one point that stands for all of them; links
    between points count for every row behind them. Rows whose vector is null, zero
    or not finite, or whose id is null, link with nothing: ``n_links`` is 0 and the
    component is their own id. Vectors of different lengths never meet. Repeated
    rows are rows of their own and link to each other. Other columns aren't read.
    An empty table gives an empty result.
    """
    plan = plan or Plan.calibrated(threshold)
    given = vectors.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and given.elementType == T.FloatType()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector")
    )
    known = stored(projected(rows, plan, seed, single), "embeddings-projected")
    same = [F.first(c).alias(c) for c in ("width", "q", "low", "v")]
    distinct = known.where("digest is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"), *same)
    points = stored(distinct, "embeddings-points")
    tiles = by_tile(placed(points, plan, cell_windows, tile_rows))
    shape = ", ".join(f"{c} int" for c in (*TILE, "visit"))
    met = stored(tiles.mapInArrow(lambda b: involved(b, plan, cell_windows), f"{shape}, node long"), "embeddings-involved")
    whole = met.join(points.select("node", F.col("width").alias("_width"), "weight", "low", "v"), "node").where("width = _width")
    whole = by_tile(whole.select(*TILE, "visit", "node", "weight", "low", "v"))
    found = stored(whole.mapInArrow(lambda b: verified(b, plan, threshold, cell_windows, single), "a long, b long, n long"), "embeddings-links")
    grouped = components(found.where("b >= 0").select("a", "b"), "embeddings")
    links = found.where("b < 0").groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n"))
    per_point = (
        points.select("digest", "node", "weight")
        .join(grouped.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
        .join(links, F.col("node") == F.col("linked"), "left")
        .select("digest", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    linked = known.where("digest is not null").select("id", "digest").join(stored(per_point, "embeddings-groups"), "digest")
    alone = known.where("digest is null").selectExpr("id", "0L as n_links", "id as component_id")
    result = linked.select("id", "n_links", "component_id").unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
