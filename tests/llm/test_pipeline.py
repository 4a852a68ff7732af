"""Every stage of the pipeline against plain Python, null and repeated ids included."""

import collections
import random
import re

import pytest
from test_dedup import exact_by_hand, plain_fingerprint, smallest_reachable
from test_text_ops import PATTERNS

import corpus_pipeline
from msgscreen.llm import quality

OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def opaque(token):
    both = all(re.search(c, token) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    one = re.fullmatch("[a-z0-9]+|[A-Z0-9]+", token) and 3 <= sum(c.isdigit() for c in token) < len(token) and len(set(token)) >= 10
    return bool(both or one)


def named(row):
    return (row.doc_id is None, row.doc_id or 0)


def near_by_hand(rows):
    """Per group of near copies the smallest id and the texts that may stay for it."""
    prints = [plain_fingerprint(r.text or "") for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = collections.defaultdict(list)
    for i, root in smallest_reachable(range(len(rows)), links).items():
        groups[root].append(rows[i])
    return [(least.doc_id, {r.text for r in g if r.doc_id == least.doc_id}) for g in groups.values() for least in [min(g, key=named)]]


def masked_by_hand(rows):
    """``doc_id, text`` with base spans and opaque values of fewer than three sources masked."""
    spans, sources = [], collections.defaultdict(set)
    for r in rows:
        text = r.text or ""
        base = [(m.start(), m.end(), m[m.lastindex or 0]) for _, p, ok in PATTERNS for m in p.finditer(text) if ok(m)]
        own = [(m.start(), m.end(), m[0]) for m in OPAQUE.finditer(text) if opaque(m[0])]
        own = [o for o in own if not any(b[0] < o[1] and o[0] < b[1] for b in base)]
        spans.append((base, own))
        for *_, value in base + own:
            sources[value].add(r.source or "")
    out = []
    for r, (base, own) in zip(rows, spans):
        chosen, at, cut = sorted(base + [o for o in own if len(sources[o[2]]) < 3]), 0, []
        for start, end, _ in chosen:
            if start >= at:
                cut.append((r.text or "")[at:start])
            at = max(at, end)
        out.append((r.doc_id, "[SECRET]".join([*cut, r.text[at:]]) if chosen else r.text))
    return out


def counted(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


@pytest.fixture(scope="module")
def documents(spark, small_dir, words, tmp_path_factory):
    """A folder like ``small_dir`` whose documents have null and repeated ids as well."""
    folder, rng = str(tmp_path_factory.mktemp("ids") / "in"), random.Random(6)
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n)) + "."
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    one, two, far = prose(20), prose(25), prose(30)
    near = far.split(" ")
    near[70] = "other"
    extra = [
        (None, prose(15)), (None, prose(18)), (None, None), (None, f"{prose(12)} token=abcdefgh1 {prose(3)}"),  # null ids
        (-1, one), (-1, one), (-1, one.upper()), (None, one),  # fully repeated rows and copies
        (-2, two), (-2, prose(22)), (-1, two),  # a copy whose id holds another text as well
        (-3, f"token=abcdefgh1 {prose(10)}"), (-3, f"{prose(10)} and {'0a' * 20} {prose(4)}"), (-3, prose(11)),  # other offsets
        (-4, "$#@ | | == %% ~~ " * 40), (-4, prose(16)),  # junk and prose of one id
        (-5, far), (-5, " ".join(near)), (None, " ".join(near) + " "),
    ]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema)
    docs.unionByName(rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_stage_is_plain_python(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{documents}/labels.parquet"), keep=("text",))
    good = {(r.id, r.text) for r in scores.collect() if r.predicted}
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    rows = docs.collect()
    docs = corpus_pipeline.stored(stages[0](spark, docs, documents), "test-quality")
    got = docs.collect()
    assert counted(got) == collections.Counter({k: n for k, n in counted(rows).items() if k in good})
    assert any(r.doc_id is None for r in got) and max(counted(got).values()) > 1

    rows = got
    docs = corpus_pipeline.stored(stages[1](spark, docs, documents), "test-exact")
    got = docs.collect()
    want = collections.Counter((i, digest) for i, _, _, kept, digest in exact_by_hand_any(rows) if kept)
    assert collections.Counter((r.doc_id, digest_of(r.text)) for r in got) == want

    rows = got
    docs = corpus_pipeline.stored(stages[2](spark, docs, documents), "test-near")
    got = docs.collect()
    want = near_by_hand(rows)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in want)
    assert all(any(r.doc_id == i and r.text in texts for i, texts in want) for r in got)
    assert not counted(got) - counted(rows)

    rows = got
    got = stages[3](spark, docs, documents).collect()
    assert counted(got) == collections.Counter(masked_by_hand(rows))
    final = corpus_pipeline.run(spark, documents).where("piece = 0").collect()
    assert collections.Counter(r.doc_id for r in final) == collections.Counter(r.doc_id for r in got)


def digest_of(text):
    return exact_by_hand([(0, text)])[0][4]


def exact_by_hand_any(rows):
    """``exact_by_hand`` with null ids below all others and one row kept of those that share the largest id."""
    low, seen = -(1 << 62), set()
    for i, keep, n, kept, digest in exact_by_hand([(low if r.doc_id is None else r.doc_id, r.text) for r in rows]):
        kept = kept and digest not in seen
        if kept:
            seen.add(digest)
        yield (None if i == low else i), keep, n, kept, digest


def test_secrets_of_null_and_repeated_ids_are_masked_row_by_row(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    got = corpus_pipeline.masked_secrets(spark, docs, documents).collect()
    assert counted(got) == collections.Counter(masked_by_hand(docs.collect()))
    masked = [r for r in got if r.doc_id in (None, -3) and "[SECRET]" in (r.text or "")]
    assert len(masked) == 3 and all(r.n_chars == len(r.text) for r in masked)


def test_rows_with_null_and_repeated_ids_are_decided_one_by_one(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{documents}/labels.parquet"), keep=("text",)).collect()
    good = corpus_pipeline.good_quality(spark, docs, documents).collect()
    assert counted(good) == collections.Counter((r.id, r.text) for r in scores if r.predicted)
    assert any(r.doc_id is None for r in good) and not any("$#@" in (r.text or "") for r in good if r.doc_id == -4)
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        kept = stage(spark, docs, documents).collect()
        assert max(counted(kept).values()) == 1 and any(r.doc_id is None for r in kept)
        assert len({r.text.lower() for r in kept if r.doc_id in (-1, -2)}) == len([r for r in kept if r.doc_id in (-1, -2)])
