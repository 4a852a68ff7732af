"""SimHash, exact and line dedup and the embedding search against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgscreen.llm import common, embeddings, exact_dedup, line_templates, queries, simhash

DOCS = "doc_id long, text string, id string, fp string, at string, digest string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], DOCS)


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = text.encode().lower().replace(b"\n", b" ").split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(1)
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([120, 400, 900]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            other[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(other))
    out += [out[0], out[0].upper(), "", " ", None, "one", "one two", "Ä ä"]
    rng.shuffle(out)
    return out


def test_simhash_is_brute_force(spark, texts):
    rows = simhash.simhash_groups(docs_of(spark, texts)).collect()
    prints = {i: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {r.id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    links = [(a, b) for a in prints for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(links) > 60
    want = smallest_reachable(prints, links)
    assert {r.id: r.component_id for r in rows} == want
    assert {r.id for r in rows if r.kept} == set(want.values())


@pytest.mark.parametrize("tile_rows", [4, 100])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_tiles_lose_no_link(spark, tile_rows, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30)
    flips = np.array([1 << b for b in range(63)])
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(12):
            prints.add(int(x) ^ int(np.bitwise_or.reduce(rng.choice(flips, rng.integers(1, 4), replace=False))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, fp long")
    pairs = simhash.close_pairs(frame, radius, tile_rows)
    grouped = {r.node: r.component for r in common.components(pairs, "test").collect()}
    want = smallest_reachable(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
    assert {i: grouped.get(i, i) for i in range(len(prints))} == want


def test_simhash_repeats_nulls_and_nothing(spark):
    rows = [(5, "a b c d", "", "", "", ""), (5, "q r s t", "", "", "", ""), (2, "q r s t", "", "", "", ""), (None, "a b c d", "", "", "", "")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.id or -1, r.component_id) for r in got) == [(-1, None), (2, 2), (5, 2), (5, 2)]
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(500, 560)] + [(7, 7), (3, 9), (9, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert got[999] == 500 and got[559] == 500 and got[9] == got[3] == 3 and 7 not in got


def exact_by_hand(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(lower), []).append(i)
    return sorted(
        (i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    )


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)])
def test_exact_dedup_is_brute_force_even_with_a_weak_digest(spark, texts, digest):
    many = [t for t in texts] + ["Hot"] * 50 + ["hOT"] * 50 + ["É", "é"]
    got = exact_dedup.exact_duplicates(docs_of(spark, many), digest=digest).collect()
    assert sorted(tuple(r) for r in got) == exact_by_hand(list(enumerate(many)))


def test_exact_dedup_over_several_batches(spark, tmp_path):
    docs_of(spark, ["a", "b", "a", "A", "c", "b"] * 20).repartition(6).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_duplicates(docs, files_per_batch=1).collect()
    want = exact_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in got) == want


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "x"), (1, "X"), (None, "x"), (None, None), (3, "")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 2
    assert sorted((r.id or 0, r.keep_id, r.group_size) for r in got) == [(0, 1, 3), (0, 3, 2), (1, 1, 3), (1, 1, 3), (3, 3, 2)]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = list(rng.standard_normal((500, 24)))
    for base in rows[:60]:
        for _ in range(rng.integers(1, 8)):
            rows.append(base + rng.standard_normal(24) * rng.choice([0.02, 0.15, 0.22]))
    rows += [rows[3]] * 30 + [rows[3] * 2.5]
    return [r.astype(np.float32).tolist() for r in rows]


@pytest.mark.parametrize("tile_rows", [16, 8192])
def test_embeddings_find_nearly_all_links_and_no_others(spark, vectors, tile_rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType())])
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows = vectors + odd
    frame = spark.createDataFrame([(i, v, "n") for i, v in enumerate(rows)], schema)
    got = {r.id: r for r in embeddings.embedding_groups(frame, tile_rows=tile_rows).collect()}
    assert len(got) == len(rows)
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.99 * close.sum()
    want = smallest_reachable(range(len(x)), np.argwhere(close).tolist())
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.99 * len(x)
    for i in range(len(x), len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embeddings_repeated_in_both_widths_of_numbers(spark, vectors):
    """Copies count as rows of their own; doubles are compared as doubles, zeros of either sign are equal."""
    some = [[float(np.float32(x)) for x in v] for v in vectors[:60]]
    some[0][0] = 0.0
    rows = [(i, v) for i, v in enumerate(some)] + [(100 + i, [-0.0, *some[0][1:]]) for i in range(5)] + [(None, some[0]), (7, some[7])]
    found = []
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        found.append(sorted(map(str, embeddings.embedding_groups(frame).collect())))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    links = {r.id: r.n_links for r in embeddings.embedding_groups(frame).collect() if r.id is not None}
    assert min(links[0], links[100]) >= 5 and links[7] >= 1


def test_embeddings_of_nothing_and_plan(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    plan = embeddings.Plan.calibrated(0.95)
    assert plan.recall >= 0.997 and 2 * plan.grids <= plan.lines


def test_lines_that_recur_go_from_all_but_the_first(spark, words):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, note = prose(60), "all rights reserved by the owner"
    texts = [f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(5)]
    texts += [f"{prose(25)}\nuser {n} logged in from 10.0.0.{n} at noon\n{note}" for n in range(4)]
    names = ["anna", "bert", "cora", "dora"]
    texts += [f"{prose(12)}\nthe system was shut down on monday evening by operator {n} for the usual reason" for n in names]
    texts += ["ok\nok\nok", "", None, prose(40)]
    got = {r.id: r for r in line_templates.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(5)] == [0, 1, 1, 1, 1]
    assert [got[i].n_dropped for i in range(5, 9)] == [0, 2, 2, 2]
    assert [got[i].n_dropped for i in range(9, 13)] == [0, 1, 1, 1]
    assert all(passage not in got[i].text for i in range(1, 5)) and passage in got[0].text
    for i in range(13, 17):
        assert got[i].n_dropped == 0 and got[i].text == (texts[i] or "")
    assert line_templates.drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_a_passage_of_two_documents_goes_from_the_second(spark, words, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    docs_of(spark, [f"{prose(30)}\n{passage}", f"{passage}\n{prose(20)}", prose(60)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_dropped for r in queries.op8_lines(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_short_lines_count_as_literal_templates(spark, words):
    rng = random.Random(10)
    prose = " ".join(rng.choice(words) for _ in range(30))
    texts = [f"{n}{prose}\nAll rights reserved.\n\nLes.\nPage {i}" for i, n in enumerate("abcd")]
    got = {r.id: r for r in line_templates.drop_recurring_lines(docs_of(spark, texts), min_tokens=1, alike=1.0).collect()}
    assert [got[i].n_dropped for i in range(4)] == [0, 2, 2, 2]
    assert got[3].text.endswith("\n\nPage 3")
    assert [r.n_dropped for r in line_templates.drop_recurring_lines(docs_of(spark, ["Les."] * 3)).orderBy("id").collect()] == [0, 1, 1]


def test_several_templates_of_one_leaf(spark, words):
    rng = random.Random(11)
    word = lambda: rng.choice(words)
    lines = [f"the system was shut down on monday evening by operator {word()}{i} for the usual reason".replace(str(i), "xyz"[i]) for i in range(3)]
    lines += [f"the system was shut up and left to itself without {'uvw'[i]}{word()} as nobody was there" for i in range(3)]
    assert len({len(x.split()) for x in lines}) == 1
    got = line_templates.drop_recurring_lines(docs_of(spark, lines)).orderBy("id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1, 0, 1, 1]
    hot = ["the system was shut for good and all of us went home in the rain"] * 30
    assert len(hot[0].split()) == len(lines[0].split())
    got = line_templates.drop_recurring_lines(docs_of(spark, hot + lines[:3])).orderBy("id").collect()
    assert [r.n_dropped for r in got] == [0] + [1] * 29 + [0, 1, 1]


def test_lines_with_null_and_repeated_ids(spark):
    line = "this line stands in many documents"
    rows = [(1, line), (1, line), (2, line), (None, line), (None, None)]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r.n_dropped == 0 for r in got)
