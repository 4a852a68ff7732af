"""Byte-level BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A text is split into words by the vocabulary's own pattern, special tokens standing
apart. Over the symbols of a word lies a segment tree whose leaves are the ranks of
the pairs they begin, each joined with its place; the root is therefore the leftmost
pair of the lowest rank. Merging it changes at most three leaves, each of which
climbs the tree only as far as minima change, and the word is done when the root
holds no pair. Words repeat, so each worker process remembers a bounded number of them.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How the vocabulary's byte-level splitter cuts a text (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_PAIR = 1 << 62
PLACE_BITS = 32  # a leaf is rank << PLACE_BITS | place: equal ranks go by place


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones as they are, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    return letters


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or spec["normalizer"] or any(splitter.get(k) != v for k, v in plain.items()):
            raise ValueError("the file must hold a byte-level BPE without normalizer and prefix space")
        letters = byte_letters()
        ids = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.first: list[int] = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = ids[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.special: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("special tokens must stand for their exact text")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None

        # All tokens' bytes in a row, by id, with a place beyond the last for what is no token.
        known = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 2)]
        self.lengths = np.array([len(b) for b in known])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(known), np.uint8)

    def decoded(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, ids outside the vocabulary nothing."""
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.lengths)), ids, len(self.lengths) - 1)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.letters[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")


class PairTree:
    """Minimum of ``rank and place`` of adjacent pairs, over a power of two of leaves."""

    __slots__ = ("size", "node")

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        padded = leaves + [NO_PAIR] * (self.size - len(leaves))
        levels = [padded]
        while len(padded) > 1:
            padded = list(map(min, padded[::2], padded[1::2]))
            levels.append(padded)
        # Long words as packed numbers: eight bytes a node instead of an object.
        node = array("q") if self.size > 4096 else []
        node.append(NO_PAIR)
        for level in reversed(levels):
            node.extend(level)
        self.node = node

    def put(self, place: int, value: int) -> None:
        """Change one leaf; ancestors follow until one keeps its minimum."""
        node, at = self.node, self.size + place
        node[at] = value
        while at > 1:
            other = node[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if node[at] == value:
                return
            node[at] = value


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges, the leftmost pair of the lowest rank first each time."""
    n = len(symbols)
    if n < 2:
        return symbols
    leaves, found = [], False
    for place, pair in enumerate(zip(symbols, symbols[1:])):
        merge = merges.get(pair)
        if merge:
            leaves.append(merge[0] << PLACE_BITS | place)
            found = True
        else:
            leaves.append(NO_PAIR)
    if not found:
        return symbols
    tree = PairTree(leaves)
    node, leaf, put = tree.node, tree.size, tree.put
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    here = (1 << PLACE_BITS) - 1
    while (least := node[1]) != NO_PAIR:
        place = least & here
        gone = after[place]
        symbol = symbols[place] = merges[symbols[place], symbols[gone]][1]
        symbols[gone] = -1
        beyond = after[place] = after[gone]
        if gone < n - 1 and node[leaf + gone] != NO_PAIR:
            put(gone, NO_PAIR)
        value = NO_PAIR
        if beyond < n:
            before[beyond] = place
            merge = merges.get((symbol, symbols[beyond]))
            if merge:
                value = merge[0] << PLACE_BITS | place
        put(place, value)
        left = before[place]
        if left >= 0:
            merge = merges.get((symbols[left], symbol))
            value = merge[0] << PLACE_BITS | left if merge else NO_PAIR
            if node[leaf + left] != value:
                put(left, value)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Texts to ids; remembers short words in two generations of at most ``words``, so that frequent ones stay.

    Ids are kept and joined as packed 32-bit numbers, as Arrow wants them.
    """

    def __init__(self, vocabulary: Vocabulary, words: int = 400_000, short: int = 64):
        self.vocabulary, self.words, self.short = vocabulary, words, short
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split: Callable[[str], list[str]] = regex.compile(SPLIT).findall

    def word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            first = self.vocabulary.first
            ids = array("i", merged([first[b] for b in word.encode()], self.vocabulary.merges)).tobytes()
        if len(word) <= self.short:
            if len(self.known) >= self.words:
                self.older = dict(self.known)
                self.known.clear()
            self.known[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in self.split(text)])

    def packed(self, text: str) -> bytes:
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self.plain(text)
        parts = self.vocabulary.special_split.split(text)
        return b"".join([array("i", [special[p]]).tobytes() if p in special else self.plain(p) for p in parts])

    def ids(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


@lru_cache(maxsize=1)
def encoder_for(vocabulary: str) -> Encoder:
    """One encoder for each worker process: its tasks share the vocabulary and the words met so far."""
    return Encoder(Vocabulary(vocabulary))


def small_batches(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col``, whose place ``ids_col`` (``array<int>``) takes.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can
    read. Whole texts are encoded; null and empty ones get an empty array. Special
    tokens written out in a text count as such. All other columns, nulls and repeated
    rows stay as they are; only ``ids_col`` may not be one of them. An empty table
    gives an empty result. Each row is encoded where it lies, without a shuffle; what
    a task holds is a few hundred rows and a bounded memory of words.
    """
    kept = [c for c in docs.columns if c != text_col]
    if ids_col in kept:
        raise ValueError(f"there is a column {ids_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        for whole in batches:
            for batch in small_batches(whole):
                packed = [encoder.packed(t) if t else b"" for t in batch.column(0).to_pylist()]
                places = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(places, np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(1), ids], ["kept", "ids"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), struct_of(docs, kept).alias("kept"))
    shape = T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    found = rows.mapInArrow(run, shape)
    return found.select(*(F.col("kept").getField(c).alias(c) for c in kept), F.col("ids").alias(ids_col))


def decoded(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the text of the ids of ``ids_col`` added as ``text_col``, special tokens included.

    Null and empty arrays give an empty text; a null id and one outside the vocabulary
    give nothing. The other columns, ``ids_col`` among them, stay as they are.
    """
    if text_col in tokens.columns:
        raise ValueError(f"there is a column {text_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_for(vocabulary).vocabulary
        for whole in batches:
            for batch in small_batches(whole):
                rows = batch.column(0)
                texts = pa.array([words.decoded(ids.values.fill_null(-1).to_numpy()) if ids.is_valid else "" for ids in rows], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(1), texts], ["kept", "text"])

    kept = tokens.columns
    rows = tokens.select(F.col(ids_col).cast("array<int>").alias("ids"), struct_of(tokens, kept).alias("kept"))
    found = rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("text", T.StringType())]))
    return found.select(*(F.col("kept").getField(c).alias(c) for c in kept), F.col("text").alias(text_col))


def struct_of(df: DataFrame, columns: list[str]):
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))
