"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The segmentations of a text are the paths of a lattice. A perturbed A-star search
takes the k paths with the largest Gumbel-perturbed log-probability: the search holds
regions of paths, each with the (exact) largest perturbed value inside it; the best
region is split into its best path, drawn edge by edge, and the regions of paths that
leave it at each edge, whose largest values are truncated Gumbels. Regions below the
k-th best known one can't win and are dropped at once, so k regions are kept at most.

The vocabulary file is a parameter. Its pieces carry merge ranks, not probabilities;
those are set to fall with the rank (Zipf), tempered by ``sharpness``.

Texts of ordinary words are searched a batch at a time (``segmentation_batches``); one with
a word of over 256 characters by itself, as the batch takes a step per edge of its longest word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segmentation_batches import Lattices, ranges, search

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED_CHARS, CACHED_UNITS = 40, 30_000
BATCH_CHARS, TOGETHER_CHARS = 1_000_000, 256  # of the texts, and of a unit, that are searched together
RANK_SHIFT = 10.0


class Sampler:
    """Lattice, search and decoder for one vocabulary file."""

    def __init__(self, model_file: str, sharpness: float = 1.0):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = {}
        self.known = {}
        rank = 0
        for i, piece in enumerate(self.pieces):
            if self.model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                rank += 1
                self.known[piece] = (i, -sharpness * math.log(rank + RANK_SHIFT))
        self.byte_cost = -sharpness * math.log(rank + RANK_SHIFT)
        self.longest = max(map(len, self.known))
        # A piece that goes on after a space would make words depend on each other.
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.cache: dict[str, list] = {}
        self.shown = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.shown[i] = bytes([b])
        sizes = np.array(list(map(len, self.shown)), np.int64)
        self.shown_bytes = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.shown), np.uint8)
        self.lattices: Lattices | None = None

    def lattice(self, unit: str) -> list:
        """Per position: running probabilities, and edges ``(end, ids, log p, log of the rest)`` given that position."""
        if unit in self.cache:
            return self.cache[unit]
        n = len(unit)
        total, steps = [0.0] * (n + 1), [None] * n
        for at in range(n - 1, -1, -1):
            edges = []
            for end in range(at + 1, min(n, at + self.longest) + 1):
                found = self.known.get(unit[at:end])
                if found:
                    edges.append((end, (found[0],), found[1] + total[end]))
            if not edges or edges[0][0] != at + 1:
                raw = unit[at].encode("utf-8", "surrogatepass")
                edges.insert(0, (at + 1, tuple(self.bytes[b] for b in raw), len(raw) * self.byte_cost + total[at + 1]))
            top = max(e[2] for e in edges)
            total[at] = top + math.log(sum(math.exp(e[2] - top) for e in edges))
            shares = [math.exp(e[2] - total[at]) for e in edges]
            sums, run = [], 0.0
            for p in shares:
                run += p
                sums.append(run)
            steps[at] = (
                sums,
                [(e[0], e[1], e[2] - total[at], math.log(max(run - p, 1e-300)) if len(edges) > 1 else -math.inf) for e, p in zip(edges, shares)],
            )
        if n <= CACHED_CHARS:
            if len(self.cache) >= CACHED_UNITS:
                self.cache.clear()
            self.cache[unit] = steps
        return steps

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """Up to ``k`` distinct segmentations, ``(ids, log p, inclusion)``, in the order of their perturbed values.

        ``inclusion`` is the chance of a path to be above the (k+1)-th value; it is 1
        when all paths were found.
        """
        if not text:
            return [([], 0.0, 1.0)]
        marked = SPACE + text.replace(" ", SPACE)
        units = UNIT.findall(marked) if self.split else [marked]
        tables = list(map(self.lattice, units))
        draw = np.random.Generator(np.random.PCG64(seed))
        # A region: (perturbed value, chosen edges so far, unit, position, excluded edges there, log p so far)
        first = -math.log(-math.log(draw.random()))
        regions = [(first, (), 0, 0, frozenset(), 0.0)]
        out = []
        while regions and len(out) <= k:
            best = max(range(len(regions)), key=lambda r: regions[r][0])
            value, trail, u, at, barred, logp = regions.pop(best)
            path, logs, rests, places = [], [], [], []
            chances = iter(draw.random(sum(map(len, tables[u:])) - at + 1).tolist())
            at_unit = u
            while at_unit < len(tables):
                table = tables[at_unit]
                while at < len(table):
                    sums, edges = table[at]
                    if barred:
                        left = [i for i in range(len(edges)) if i not in barred]
                        mass = sum(math.exp(edges[i][2]) for i in left)
                        aim, i = next(chances) * mass, left[-1]
                        for c in left:
                            aim -= math.exp(edges[c][2])
                            if aim < 0:
                                i = c
                                break
                        # the region's own mass is that of the edges left; what stays is without this one
                        rest = mass - math.exp(edges[i][2])
                        rest = math.log(rest) if len(left) > 1 and rest > 0 else -math.inf
                    else:
                        i = min(bisect_right(sums, next(chances) * sums[-1]), len(edges) - 1)
                        rest = edges[i][3]
                    places.append((at_unit, at, barred, i))
                    rests.append(rest)
                    logs.append(edges[i][2])
                    path.append(edges[i][1])
                    barred, at = frozenset(), edges[i][0]
                at_unit, at = at_unit + 1, 0
            before = logp + np.concatenate(([0.0], np.cumsum(logs)))
            out.append((trail, path, float(before[-1]), value))
            room = k + 1 - len(out)
            if not room:
                break
            spots = before[:-1] + np.array(rests)
            with np.errstate(divide="ignore", over="ignore"):
                bounded = spots - np.logaddexp(spots - value, np.log(-np.log(draw.random(len(spots)))))
            alive = np.flatnonzero(np.isfinite(bounded))
            if len(alive) > room:
                alive = alive[np.argpartition(-bounded[alive], room - 1)[:room]]
            for i in sorted(alive.tolist()):
                unit, place, closed, edge = places[i]
                regions.append((float(bounded[i]), (trail, path, i), unit, place, closed | {edge}, float(before[i])))
            if len(regions) > room:
                regions = sorted(regions, key=lambda r: -r[0])[:room]
        limit = out[k][3] if len(out) > k else -math.inf
        answer = []
        for trail, path, logp, _ in out[:k]:
            chance = -math.expm1(-math.exp(min(logp - limit, 50.0))) if limit > -math.inf else 1.0
            answer.append(([x for ids in unrolled(trail, path) for x in ids], logp, chance))
        return answer

    def sample_many(self, texts: list[str], k: int, seeds: list[int]) -> tuple[np.ndarray, ...]:
        """``text, rank, ids, offsets, log p, inclusion`` of up to ``k`` segmentations of each text, by text and rank.

        Texts of ordinary units are searched together, those with a longer one by themselves.
        """
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        units = [UNIT.findall(m) if self.split else [m] if m else [] for m in marked]
        alone = [t for t, own in enumerate(units) if own and max(map(len, own)) > TOGETHER_CHARS]
        if self.lattices is None:
            self.lattices = Lattices(self.known, self.byte_cost)
        for t in alone:
            units[t] = []
        text, rank, symbols, offsets, log_p, inclusion = search(self.lattices, units, seeds, k)
        ids, offsets = self.ids_of(symbols, offsets)
        if not alone:
            return text, rank, ids, offsets, log_p, inclusion
        parts = []
        for t in range(len(texts)):
            if t in set(alone):
                parts += [(t, r, np.array(i, np.int64), p, c) for r, (i, p, c) in enumerate(self.sample(texts[t], k, seeds[t]))]
            else:
                lo, hi = np.searchsorted(text, (t, t + 1))
                parts += [(t, rank[j], ids[offsets[j] : offsets[j + 1]], log_p[j], inclusion[j]) for j in range(lo, hi)]
        text, rank, ids, log_p, inclusion = zip(*parts)
        return np.array(text), np.array(rank), np.concatenate(ids), np.append(0, np.cumsum(list(map(len, ids)))), np.array(log_p), np.array(inclusion)

    def ids_of(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with characters without a piece written as the ids of their bytes."""
        raw = symbols < 0
        if not raw.any():
            return symbols, offsets
        chars = [chr(-1 - s).encode("utf-8", "surrogatepass") for s in symbols[raw].tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[raw] = list(map(len, chars))
        ids = np.repeat(symbols, counts)
        ids[ids < 0] = [self.bytes[b] for b in b"".join(chars)]
        return ids, np.append(0, np.cumsum(counts))[offsets]

    def round_trips(self, texts: list[str], row: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether each segmentation decodes to its text, space marks as spaces."""
        start, size, flat = self.shown_bytes
        ends = np.append(0, np.cumsum(size[ids]))[offsets].tolist()
        decoded = flat[ranges(start[ids], size[ids])].tobytes()
        wanted = [t.replace(SPACE, " ") for t in texts]
        raw = [t.encode() for t in wanted]
        answer = []
        for i, t in enumerate(row.tolist()):
            same = decoded[ends[i] : ends[i + 1]].removeprefix(b" ") == raw[t]
            answer.append(same or self.decode(ids[offsets[i] : offsets[i + 1]].tolist()) == wanted[t])
        return answer

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: pieces joined, bytes put together, the first space mark taken off."""
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def unrolled(trail: tuple, path: list) -> list:
    """The edges of a path that shares beginnings with earlier ones."""
    parts = [path]
    while trail:
        trail, earlier, upto = trail
        parts.append(earlier[:upto])
    return [edge for part in reversed(parts) for edge in part]


def sampled_segmentations(
    docs: DataFrame, keys: list[str], text_col: str, model_file: str, k: int = 4, sharpness: float = 1.0, seed: int = 0
) -> DataFrame:
    """``key, rank, ids, log_p, inclusion, round_trip`` for each row: up to ``k`` distinct segmentations.

    ``key`` joins the key columns by ``:`` and seeds the row's draws, so equal keys
    with equal texts give equal samples wherever they run. A null text is empty; an
    empty text has one segmentation, without ids. A space mark inside a text comes
    back as a space, as in the tokenizer itself; ``round_trip`` tells whether the ids
    decode to the text with such marks as spaces. Other columns aren't read. An empty
    table gives an empty result. Rows are independent: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model_file, sharpness)
        for batch in batches:
            keys_, texts = batch.column(0), batch.column(1).to_pylist()
            seeds = [xxhash.xxh64_intdigest(key.encode(), seed) for key in keys_.to_pylist()]
            for lo, hi in runs_of(list(map(len, texts)), BATCH_CHARS):
                row, rank, ids, offsets, log_p, inclusion = sampler.sample_many(texts[lo:hi], k, seeds[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        keys_.take(pa.array(row + lo)),
                        pa.array(rank.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.array(log_p),
                        pa.array(inclusion),
                        pa.array(sampler.round_trips(texts[lo:hi], row, ids, offsets)),
                    ],
                    ["key", "rank", "ids", "log_p", "inclusion", "round_trip"],
                )

    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key string, rank int, ids array<int>, log_p double, inclusion double, round_trip boolean")


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Rows cut into runs of at most ``most`` in size, or of a single row."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if sizes:
        yield lo, len(sizes)
