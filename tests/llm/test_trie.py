"""The conversation trie against a plain one, with small blocks and hard rows."""

import collections
import hashlib
import random
import zlib

import pytest

from msgscreen.llm import prefix_trie, queries

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SHAPE = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """All node rows, from plain sequences and their prefixes."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        key = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1][:100], x[2][:100], key(x)))
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        rebuilt = tuple((r, t) for _, r, t in own.get(base, [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(conv)
        ends[rebuilt].append(conv)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        own_bytes = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[c] for c in below) + (len(members[node]) - 1) * own_bytes
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], digest))
    return collections.Counter(out)


def counted(df):
    return collections.Counter(tuple(r[n] for n in NAMES) for r in df.collect())


def hard_rows(seed):
    rng = random.Random(seed)
    texts = ["", None, "yes", "no", "né", "a longer turn that repeats", "x" * 500]
    rows = []
    for conv in [*range(-12, 60), 10**15, -(10**15) - 3]:
        if rng.random() < 0.8:
            for turn in range(rng.choice([1, 2, 3, 8, 12])):
                # Numbers of different conversations name like turns, so that sequences share beginnings.
                rows.append((conv, turn, ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.3 else f"turn {turn}"))
    rows += [(7, None, None, None), (7, None, "user", "hi"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 0, "user", "nobody's")]
    rows += [(200 + 5 * c, t, "user", f"copy {t}") for c in range(30) for t in range(6)]
    rows += [(1000, t, "user", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_rows_by_blocks_of_any_size(spark, seed):
    rows = hard_rows(seed)
    expected = by_hand(rows)
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    for block_keys in (1, 2, 7, 50_000):
        assert counted(prefix_trie.prefix_trie(df, block_keys=block_keys)) == expected


def test_given_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/conversations.parquet")
    assert counted(queries.op11_trie(spark, small_dir)) == by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_layouts_grow_and_find_everything():
    rng = random.Random(5)
    for spread in (3, 12, 40, 256):
        keys = sorted({bytes(rng.randrange(spread) for _ in range(8 * rng.randint(0, 3))) for _ in range(1500)})
        root = None
        for key in rng.sample(keys, len(keys)):
            root = prefix_trie.insert(root, key, key)
        kinds, stack, seen = set(), [(root, 0)], []
        while stack:
            node, at = stack.pop()
            if node.value is not None:
                seen.append(node.value)
                assert node.end == len(node.value) and node.key[: node.end] == node.value
            if node.kids:
                kinds.add(getattr(node.kids, "room", type(node.kids).__name__))
                stack.extend((kid, node.end + 1) for _, kid in node.kids.items())
                assert len(node.kids.items()) > 1 or node.value is not None or node is root
        assert sorted(seen) == keys
        assert {3: 4, 12: 16, 40: "Indexed", 256: "Direct"}[spread] in kinds


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert prefix_trie.prefix_trie(empty).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SHAPE)).count() == 0
    clash = spark.createDataFrame([(3, 0, "user", "x", 1, "y", 2)], SHAPE + ", at long, digest string, conv long")
    assert counted(prefix_trie.prefix_trie(clash)) == by_hand([(3, 0, "user", "x")])


def test_very_long_text(spark):
    rows = [(c, 0, "user", "é" * 2_000_000) for c in (5, 6)]
    assert counted(prefix_trie.prefix_trie(spark.createDataFrame(rows, SHAPE))) == by_hand(rows)
