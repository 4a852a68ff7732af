"""Best-fit packing of tokenised documents by bin completion.

Spark tokenises, cuts long documents into pieces and counts the pieces by length;
that histogram, one number per possible length, is all the solver sees. It takes the
largest length left, enumerates the undominated fillings of the rest of its sequence
and applies a filling to as many sequences as the counts allow; a best-fit packing is
the incumbent, and branches whose waste can't beat it are cut. The plan is a list of
patterns, and Spark gives every piece its place by its rank within its length.
"""

from __future__ import annotations

import base64
import logging
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

log = logging.getLogger(__name__)

# How the tokenizer itself splits a text before its merges (a fixed value of the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096  # parts of a length in which pieces are ranked, so that a length shared by many splits


class Ids:
    """Token ids of texts.

    ``ranks`` holds the vocabulary in rank form, with which a text is encoded several
    times faster; the ids are the same. Texts that spell out a special token go to
    the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})

    def of(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its pattern needs a stack as deep as a run of blanks is long
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces_of(docs: DataFrame, vocabulary: str, ranks: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every row; null texts are empty, and every document ends in ``end_id``."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary, ranks)
        for batch in batches:
            columns = [[], [], [], [], []]
            for row, text in enumerate(batch.column(1)):
                data = ids.of(text.as_py() or "") + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(columns, (row, k, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi]))):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(arrays[0]), arrays[1].cast(pa.int32()), *arrays[2:]], ["id", "piece", "start", "length", "ids_crc32"]
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------------------
# The solver: patterns over a histogram of lengths
# ---------------------------------------------------------------------------
def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on classes of equal sequences: ``(lengths, how many sequences)``."""
    open_by_room: dict[int, list] = {}
    rooms: list[int] = []
    full = []

    def put(items: tuple, room: int, n: int) -> None:
        if room == 0:
            full.append((items, n))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((items, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room, (items, n) = (rooms[at], open_by_room[rooms[at]].pop()) if at < len(rooms) else (capacity, ((), left))
            if items and not open_by_room[room]:
                del open_by_room[room], rooms[at]
            each = min(room // length, left)
            whole = min(n, left // each)
            if n > whole:
                if items:
                    put(items, room, n - whole)
            put(items + (length,) * each, room - each * length, whole)
            left -= each * whole
    return full + [x for group in open_by_room.values() for x in group]


def fillings(room: int, counts: dict[int, int], lengths: list[int], width: int) -> list[tuple[int, ...]]:
    """The ``width`` fullest undominated fillings of ``room``, the fullest first, larger pieces first among equals.

    A filling is dominated if a piece left out would still fit, or could replace
    smaller ones of it; fuller fillings by larger pieces dominate the others.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [4000]

    def extend(room: int, at: int, chosen: tuple[tuple[int, int], ...]) -> None:
        """Go on with the lengths below ``at``; one level a length, so that many small pieces need no deep stack."""
        budget[0] -= 1
        top = bisect_right(lengths, room, 0, at) - 1
        while top >= 0 and not counts[lengths[top]]:
            top -= 1
        if top < 0:
            used = dict(chosen)
            fits = lengths[: bisect_right(lengths, room)]
            if all(used.get(x, 0) >= counts[x] for x in fits):
                found.append((room, tuple(x for x, n in chosen for _ in range(n))))
            return
        while top >= 0 and budget[0] > 0:
            length = lengths[top]
            for n in range(min(counts[length], room // length), 0, -1):
                extend(room - n * length, top, (*chosen, (length, n)))
                if budget[0] <= 0 or (found and found[-1][0] == 0 and sum(r == 0 for r, _ in found) >= width):
                    return
            top -= 1

    extend(room, len(lengths), ())
    found.sort(key=lambda f: f[0])
    return [c for _, c in found[:width]]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a sequence stand alone, and the room beside large ones is of no use to middling ones."""
    lengths = sorted(counts)
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    for small in range(0, capacity // 2 + 1):
        alone = sum(counts[x] for x in lengths if x > capacity - small)
        half = [x for x in lengths if capacity - small >= x > capacity // 2]
        n_half = sum(counts[x] for x in half)
        room = sum((capacity - x) * counts[x] for x in half)
        middling = sum(x * counts[x] for x in lengths if capacity // 2 >= x >= small)
        best = max(best, alone + n_half + max(0, -(-(middling - room) // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, width: int = 3, nodes: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion, branch and bound, within a number of nodes for improving on the incumbent.

    A node uses up one length or more, so a descent takes as many nodes as there are
    lengths at most; by default there are nodes for four descents. The log tells the
    sequences, the lower bound and whether the search or best fit gave the result.
    """
    counts = {k: v for k, v in counts.items() if v}
    nodes = max(1500, 4 * len(counts)) if nodes is None else nodes
    incumbent = best_fit(counts, capacity)
    least = least_sequences(counts, capacity)
    best = [sum(n for _, n in incumbent), incumbent]
    spare = lambda: (best[0] - 1) * capacity - sum(k * v for k, v in counts.items())  # noqa: E731  waste that still improves

    # Depth first with an own stack: (counts left, patterns so far, waste so far).
    stack = [(dict(counts), (), 0)]
    while stack and best[0] > least and nodes:
        nodes -= 1
        left, plan, waste = stack.pop()
        if not left:
            total, patterns, node = 0, [], plan
            while node:
                node, pattern, n = node
                patterns.append((pattern, n))
                total += n
            if total < best[0]:
                best[:] = [total, patterns]
            continue
        lengths = sorted(left)
        largest = lengths[-1]
        rest = dict(left)
        rest[largest] -= 1
        nexts = []
        for filling in fillings(capacity - largest, rest, lengths, width):
            pattern = (largest, *filling)
            need = {x: pattern.count(x) for x in pattern}
            n = min(left[x] // c for x, c in need.items())
            more = waste + n * (capacity - sum(pattern))
            after = {x: left[x] - n * need.get(x, 0) for x in left}
            after = {x: c for x, c in after.items() if c}
            # What is left may still fill its last sequence only partly: that waste is not avoidable either.
            more_at_least = more + (-sum(x * c for x, c in after.items())) % capacity if not after else more
            if more_at_least <= spare():
                nexts.append((after, (plan, pattern, n), more))
        stack.extend(reversed(nexts))
    winner = "best fit" if best[1] is incumbent else "bin completion"
    log.info("%d sequences by %s, lower bound %d, best fit %d", best[0], winner, least, sum(n for _, n in incumbent))
    return best[1]


def plan_runs(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows ``key of the first rank, pieces per sequence, first sequence, offset of the first piece``, sorted by key.

    The pieces of one length are used up in rank order, pattern by pattern.
    """
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rank = used.get(length, 0)
            runs.append((length << 48 | rank, each, sequence, offset))
            used[length] = rank + each * n
            offset += each * length
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def packed(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Documents longer than ``capacity`` are cut; only their first piece may be
    shorter. Null and empty texts are the end token alone. Null and repeated ids are
    packed like any other row. Other columns aren't read. An empty table gives an
    empty result. Special tokens written out in a text count as such tokens, as the
    tokenizer has it by default.

    The driver gets one count per length (``capacity`` numbers). Pieces of a length
    are ranked within hash buckets whose counts are summed up before, so a length
    that a third of all pieces share is ranked by many tasks.
    """
    pieces = pieces_of(docs, vocabulary, ranks, end_id, capacity, id_col, text_col)
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    pieces = stored(pieces.withColumn("bucket", bucket), "packing-pieces")
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = stored(by_bucket, "packing-counts")
    rows = by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs = plan_runs(complete({r.length: r.n for r in rows}, capacity), capacity)
    so_far = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("within", F.row_number().over(within)).join(starts, ["length", "bucket"])
    key = F.shiftleft(F.col("length"), 48).bitwiseOR(F.col("before") + F.col("within") - 1)
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", key.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = batch.column(5).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(runs[:, 0], keys, side="right") - 1
            first, each, sequence, offset = runs[at].T
            turn = keys - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + turn // each), pa.array(offset + turn % each * lengths)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    shape = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, shape)
