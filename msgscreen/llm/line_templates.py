"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: first by token count, then by their leading tokens,
with fields that hold digits replaced by a wildcard; lines with fewer tokens than the
tree is deep are literal. In a leaf that several documents share, lines are compared by
position: the tokens are cut into a few consecutive fields, and lines that agree in
enough of them follow one template, in which the other fields are wildcards. A leaf
holds any number of templates, and a line follows each that it agrees with; without
any it is a template of its own. Templates that recur across documents are dropped
from all documents but the first that holds them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

FIELDS = 8
HASHES = [f"h{i}" for i in range(FIELDS)]


def parsed_lines(rows: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``id, twin, pos, leaf, line, n, h0..`` per line of ``min_tokens`` tokens or more; ``rows``: ``id, twin, text``."""
    # Tokens are cut before lines become rows, so that they are cut once, and each is tested by itself:
    # a pattern that looks for digits across a line would try every place of a long token.
    tokens = F.transform(F.split("text", "\n"), lambda line: F.array_remove(F.split(line, r"\s+"), ""))
    lines = rows.select("id", "twin", F.posexplode(tokens).alias("pos", "own")).where(F.size("own") >= min_tokens)
    masked = F.transform("own", lambda x: F.when(x.rlike("[0-9]"), "<*>").otherwise(x))
    lines = lines.select("id", "twin", "pos", F.when(F.size("own") < depth, F.col("own")).otherwise(masked).alias("t"))
    lines = lines.withColumn("n", F.size("t"))

    def content(i: int) -> Column:
        lo, hi = (f"cast(floor(n * {k} / {FIELDS}) as int)" for k in (i, i + 1))
        return F.expr(f"case when {hi} > {lo} then xxhash64(slice(t, {lo} + 1, {hi} - {lo})) end").alias(HASHES[i])

    leaf = F.xxhash64("n", F.slice("t", 1, depth))
    return lines.select("id", "twin", "pos", leaf.alias("leaf"), F.xxhash64("t").alias("line"), "n", *map(content, range(FIELDS)))


def template_keys(depth: int, alike: float) -> Column:
    """One hash per template that a line of a leaf may follow, from its ``leaf, n, h0..``.

    Lines that agree in at least a share ``alike`` of their fields agree in some
    choice of exactly so many: one key per choice of the wildcards. Fields inside the
    leading tokens are the same in the whole leaf and never wildcards.
    """
    need = lambda fields: math.ceil(fields * alike - 1e-9)
    keys, number = [], itertools.count()

    def fields_of(n: int) -> tuple[int, list[int]]:
        """Number of fields of a line of ``n`` tokens, and those that may differ within its leaf."""
        spans = [(n * i // FIELDS, n * (i + 1) // FIELDS) for i in range(FIELDS)]
        return sum(hi > lo for lo, hi in spans), [i for i, (lo, hi) in enumerate(spans) if hi > lo and hi > depth]

    by_choice: dict[tuple[int, ...], list[int]] = {}
    last = max(FIELDS, depth * FIELDS) + FIELDS  # from here on no field lies within the leading tokens
    for n in range(1, last + 1):
        fields, free = fields_of(n)
        for choice in itertools.combinations(free, min(fields - need(fields), len(free))):
            if choice:
                by_choice.setdefault(choice, []).append(n)
    for choice, sizes in by_choice.items():
        rest = [F.col(h) for i, h in enumerate(HASHES) if i not in choice]
        key = F.xxhash64(F.lit(next(number)), "leaf", *rest)
        keys.append(F.when(F.least("n", F.lit(last)).isin(sizes), key))
    return F.array_compact(F.array(*keys)) if keys else F.expr("cast(array() as array<bigint>)")


def recurring_templates(by_line: DataFrame, lines: DataFrame, min_docs: int, depth: int, alike: float) -> DataFrame:
    """``leaf, line, first`` of the lines that follow a template held by ``min_docs`` documents; ``first`` holds it first."""
    leaves = by_line.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("kinds"))
    shared = by_line.join(leaves.where(f"n >= {min_docs} and kinds > 1").select("leaf"), "leaf", "left_semi")
    at = shared.select("leaf", "line", "docs", "first", F.explode(template_keys(depth, alike)).alias("key"))
    at = stored(at, "lines-keys")
    # A template with one kind of line is that line; of the others, those with a frequent line recur without counting.
    wide = at.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("docs").alias("most"), F.min("first").alias("first"))
    wide = stored(wide.where("kinds > 1").select("key", "most", "first"), "lines-templates")
    rare = at.join(wide.where(f"most < {min_docs}").select("key"), "key").select("leaf", "line", "key")
    # Lines of one template may stand in the same document, which counts once.
    held = lines.select("leaf", "line", "id").join(rare, ["leaf", "line"]).groupBy("key", "id").agg(F.lit(1).alias("one"))
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(f"docs >= {min_docs}").select("key")
    recurring = wide.where(f"most >= {min_docs}").select("key", "first").unionByName(wide.join(counted, "key", "left_semi").select("key", "first"))
    return at.join(recurring.withColumnRenamed("first", "earliest"), "key").groupBy("leaf", "line").agg(F.min("earliest").alias("first"))


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    depth: int = 4,
    min_tokens: int = 1,
    alike: float = 0.7,
) -> DataFrame:
    """``id, text, n_lines, n_dropped``: each row's text without recurring lines.

    A template recurs if ``min_docs`` documents hold it; its lines stay in the
    document with the smallest id, unless that is not the first for another template
    of theirs. Lines of fewer than ``min_tokens`` tokens (by default blank ones)
    always stay. Null texts are empty; rows with a null id keep all lines and count for
    none; rows that repeat an id count as one document. Other columns aren't read.
    An empty table gives an empty result.

    Lines travel as hashes, counts combine before each shuffle, and where a line in
    a third of all documents meets its verdict, that side has one row a line.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    lines = stored(parsed_lines(rows.where("id is not null"), depth, min_tokens), "lines")
    held = lines.groupBy("leaf", "line", "n", *HASHES, "id").agg(F.lit(1).alias("one"))
    by_line = held.groupBy("leaf", "line", "n", *HASHES).agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"))
    by_line = stored(by_line, "lines-distinct")
    own = by_line.where(f"docs >= {min_docs}").select("leaf", "line", "first")
    found = own.unionByName(recurring_templates(by_line, lines, min_docs, depth, alike))
    dropped = stored(found.groupBy("leaf", "line").agg(F.min("first").alias("first")), "lines-dropped")
    gone = lines.select("id", "twin", "pos", "leaf", "line").join(dropped, ["leaf", "line"]).where("id > first")
    gone = gone.groupBy("id", "twin").agg(F.collect_set("pos").alias("gone"))
    found = rows.join(gone, ["id", "twin"], "left").select("id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, cuts = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = text.split("\n")
                counts.append(len(parts))
                cuts.append(len(gone or ()))
                if gone:
                    away = set(gone)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in away)
                texts.append(text)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n_lines", "n_dropped"])

    return found.mapInArrow(run, "id long, text string, n_lines long, n_dropped long")
