"""Secrets, urls, quality, WARC, SentencePiece, packing and the pipeline against brute force and round trips."""

import base64
import collections
import math
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from msgscreen.llm import packing, quality, queries, secrets, url_filter, warc
from msgscreen.llm import sentencepiece_sampling as sampling

PATTERNS = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def check_base(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_secrets_of_all_documents_are_brute_force(spark):
    small_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.op2_secrets(spark, small_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_hex for r in rows) > 0
    check_base(rows, texts)


def test_secret_edges_and_ownership(spark):
    live, copied = "Zx9" + "aB3dE5fG7hJ9kL1mN3pQ", "Qw8" + "rT5yU7iO9pA1sD3fG5hJ"
    texts = [
        "secret: token: abcdefghij", 'api_key = "12345678"', "password==abcdefgh", "tOkEn='short'", "AKIAAKIA" + "A1" * 9, "AKIA1",
        "é\U0001f600 token=" + "ab" * 20, "f" * 31 + " " + "f" * 32, "", None, "x\ntoken=abcdefgh\ntoken=abcdefgh", f"at {live} end", f"{copied} a", f"b {copied}", f"c {copied} d",
    ]
    frame = spark.createDataFrame([(i, t, f"s{i}", "h") for i, t in enumerate(texts)], "doc_id long, text string, source string, hash string")
    rows = secrets.span_digest(secrets.scan_secrets(frame)).collect()
    check_base(rows, dict(enumerate(texts)))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[11].spans == f"opaque:3:{3 + len(live)}" and by_id[11].n_live == 1
    assert by_id[12].spans == "" and by_id[12].n_example == 1
    nulls = spark.createDataFrame([(None, "token=abcdefgh", None), (None, None, None)], "doc_id long, text string, source string")
    assert sorted(len(r.base) for r in secrets.scan_secrets(nulls).collect()) == [0, 1]
    assert secrets.scan_secrets(nulls.limit(0)).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: re.split(f"[{stops}]", s, maxsplit=1)[0]
    host = cut(rest, "/?#")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), cut(rest[len(host):], "?#")


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls_are_split_and_ruled_as_by_hand(spark, small_dir):
    odd = [None, "", "no scheme", "http://A.Example.COM/en/1?x#y", "://", "http://x.net", "http://x.net?/es/", "ftp://example.com/en/", "http://www.example.com/en/9",
           "http://a.www.example.com/en/9", "http://badexample.com/en/1", "http://É.net/fr/\n2", "a://b://c/d"]
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "url")
    frame = pages.unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    frame = frame.withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    rows = url_filter.judge_urls(frame, queries.URL_RULES).collect()
    urls = {r.page_id: r.url for r in frame.collect()}
    assert len(rows) == frame.count()
    for r in rows:
        if r.id > 0:
            host, path = plain_url(urls[r.id])
            rule, verdict = plain_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert {(r.host, r.path) for r in rows if r.id <= 0} >= {plain_url(u) for u in odd[1:]}
    learned = [r for r in rows if r.rule is None]
    assert all((r.verdict == "block") == (r.purity >= 0.5) for r in learned)
    assert url_filter.judge_urls(frame.limit(0), queries.URL_RULES).count() == 0


def test_url_tree_merges_and_generalises(spark):
    rows = [(i, f"http://h.net/{a}/{i}") for i, a in enumerate(["en", "de"] * 5 + ["es", "fr"] * 5)]
    rows += [(100 + i, f"http://k.org/{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[0].template == got[1].template == "/de+/*" and got[10].template == got[11].template == "/es+/*"
    assert {got[100 + i].template for i in range(60)} == {"/*"}


def tree_by_hand(pages, tree=url_filter.Tree()):
    """``url -> (template, purity, verdict)`` by plain recursion over each host's paths."""
    seen = collections.defaultdict(lambda: [0, 0, 0])
    where = {}
    for url in pages:
        host, path = plain_url(url)
        rule = plain_rule(host, path)[1]
        shape = re.sub("[0-9]+", "*", path)
        where[url] = (host, shape, rule)
        counts = seen[host, shape]
        counts[0] += 1
        counts[1] += rule is not None
        counts[2] += rule == "block"
    smooth = lambda b, n, prior, weight: (b + prior * weight) / (n + weight)
    out = {}

    def settle(host, members, prefix, share):
        """``members``: shape -> segments left."""
        if len(set(members.values())) == 1:
            for shape, rest in members.items():
                out[host, shape] = (prefix + "".join(f"/{x}" for x in rest), share)
            return
        lists = list(members.values())
        agree = 0
        while all(len(x) > agree for x in lists) and len({x[agree] for x in lists}) == 1:
            agree += 1
        prefix += "".join(f"/{x}" for x in lists[0][:agree])
        branches = collections.defaultdict(dict)
        for shape, rest in members.items():
            branches[f"/{rest[agree]}" if len(rest) > agree else ""][shape] = rest[agree + 1 :]
        info = {}
        for branch, own in branches.items():
            n, labelled, blocked = (sum(seen[host, s][k] for s in own) for k in range(3))
            step = -1 if not labelled else math.floor(min(blocked / labelled, 0.999) * tree.purity_steps)
            info[branch] = (n, labelled, blocked, (branch == "", frozenset(own.values())), step)
        rows = sum(i[0] for i in info.values())
        own_value = sum(i[0] == 1 for b, i in info.items() if b)
        add = lambda chosen: (sum(i[2] for i in chosen), sum(i[1] for i in chosen))
        moved = collections.defaultdict(dict)
        for branch, (n, labelled, blocked, looks, step) in info.items():
            like = sorted(b for b, i in info.items() if i[3:] == (looks, step))
            if branch and own_value >= tree.open_share * (rows + tree.doubt_rows):
                name, spoken = "/*", add(info.values())
            else:
                name = like[0] + "+" if len(like) > 1 else branch
                spoken = add([info[b] for b in like])
                if not spoken[1]:
                    spoken = add([i for i in info.values() if i[3] == looks])
            moved[name].update({s: (r, smooth(*spoken, share, tree.node_weight)) for s, r in branches[branch].items()})
        for name, below in moved.items():
            settle(host, {s: r for s, (r, _) in below.items()}, prefix + name, max(x for _, x in below.values()))

    for host in {h for h, _ in seen}:
        shapes = {s: tuple(s.removeprefix("/").split("/")) for h, s in seen if h == host}
        n, labelled, blocked = (sum(seen[host, s][k] for s in shapes) for k in range(3))
        settle(host, shapes, "", smooth(blocked, labelled, tree.prior, n - labelled + tree.node_weight) if labelled else 0.0)
    sums = collections.defaultdict(lambda: [0, 0, 0.0])
    for (host, shape), (template, share) in out.items():
        total = sums[host, template]
        total[0] += seen[host, shape][2]
        total[1] += seen[host, shape][1]
        total[2] = max(total[2], share)
    found = {}
    for url, (host, shape, rule) in where.items():
        template = out[host, shape][0]
        purity = smooth(*sums[host, template], tree.node_weight)
        found[url] = (template, purity, rule or ("block" if purity >= tree.reject_at else "allow"))
    return found


def test_url_tree_equals_plain_recursion(spark, small_dir):
    rng = random.Random(12)
    word = lambda: rng.choice(["en", "es", "fr", "de", "a", "b", "shop", "", "x1", "post", "é"])
    hosts = ["h.net", "www.example.com", "example.com", "a.example.com", "o.org", "p.org"]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(word() for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    urls += [f"http://h.net/es/item/{chr(97 + i % 26)}{chr(97 + i // 26)}/view" for i in range(300)]  # an open position, deep in a host
    urls += [f"http://o.org/{'deep/' * 40}{x}/{i}/end" for x in "abc" for i in range(9)]  # far below three segments
    urls += [f"http://p.org/u/{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for i in range(100) for w in ("", "/edit")] + ["http://o.org", "no scheme"]
    urls += [r.url for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect() if r.url]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    want = tree_by_hand(urls)
    got = {urls[r.id]: (r.template, r.purity, r.verdict) for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
    assert got.keys() == want.keys()
    for url, (template, purity, verdict) in got.items():
        assert (template, verdict) == (want[url][0], want[url][2]) and purity == pytest.approx(want[url][1]), url
    assert any("/*" in t for t, *_ in want.values()) and any("+" in t for t, *_ in want.values())


def test_wildcards_do_not_come_with_the_size_of_the_table(spark):
    """A fixed set of values stays apart however many rows it has; values that keep being new become a wildcard early."""
    fixed = lambda n: [f"http://h.net/{chr(97 + i % 25)}/x" for i in range(n)]
    fresh = lambda n: [f"http://f.net/{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}/x" for i in range(n)]
    for n in (60, 600, 2000):
        urls = fixed(n) + fresh(n)
        found = tree_by_hand(urls)
        rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {urls[r.id]: r.template for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
        assert got == {u: t for u, (t, *_) in found.items()}
        assert {got[u] for u in fresh(n)} == {"/*/x"} and "/*/x" not in {got[u] for u in fixed(n)}


def test_urls_without_a_rule_follow_the_tree(spark):
    urls = [f"http://h.net/{a}/{i}" for a in ("es", "fr", "en") for i in range(4)]
    urls += [f"http://h.net/about/{w}/{i}" for w in "ab" for i in range(20)]  # another subtree than the blocked ones
    urls += [f"http://o.org/{a}/{i}" for a in ("es", "fr", "en") for i in range(4)]
    urls += [f"http://example.com/{a}/{i}" for a in ("en", "de") for i in range(4)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {urls[r.id]: r for r in url_filter.judge_urls(frame, queries.URL_RULES).collect()}
    verdict = lambda start: {r.verdict for u, r in rows.items() if u.startswith(start)}
    assert verdict("http://h.net/en/") == {"block"} and verdict("http://h.net/about/") == {"allow"}
    assert verdict("http://o.org/") == {"allow"} and {r.purity for u, r in rows.items() if "o.org" in u} == {0.0}
    blocked = [f"http://x.net/es/{i}" for i in range(300)] + [f"http://y{i}.org/en/{i}" for i in range(50)]
    frame = spark.createDataFrame(list(enumerate(blocked)), "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(frame, queries.URL_RULES).collect() if r.host.endswith(".org")} == {"allow"}


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_quality(spark, sf_dir).collect()}
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert sum(r.predicted == q for r, q in held) / len(held) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "fine text", "c"), (1, " \n", "d"), (3, "x" * 500_000, "e")], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).count() == 5
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=10)
    assert (2, 7) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 7 * 40)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", "é"), (101, "again", "é"), (None, "n", "only"), (None, "n", "é"), (102, "w", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    listing = warc.write_archives(pages, str(tmp_path))
    got = warc.read_archives(listing, str(tmp_path)).collect()
    first = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        first[h or ""] = max(first[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        own = first[h or ""] in (i, -1)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if own else "revisit", None if own else first[h or ""]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path)), str(tmp_path)).count() == 0

    # Record ids are unique, and every revisit names the record of a response with its payload.
    heads = []
    for (name,) in listing.select("archive").collect():
        with open(name, "rb") as file:
            heads += [warc.parsed(data)[0] for data in warc.records_of(file)]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) == len(rows)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            response = ids[h["WARC-Refers-To"]]
            assert response["WARC-Type"] == "response" and response["X-Page-Key"] == h["X-Refers-To-Key"]
            assert response["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


def test_many_small_archives_are_read_by_bytes(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(cast(id as string), 20) as html").repartition(4)
    listing = warc.write_archives(pages, str(tmp_path), raw_bytes=4000)
    n, size = listing.agg(F.count("archive"), F.sum("bytes")).first()
    assert n > 300
    for per_task in (size, size // 20, 1):
        found = warc.read_archives(listing, str(tmp_path), bytes_per_task=per_task)
        # ranges are chosen from a sample, so that a few may fall together
        assert found.rdd.getNumPartitions() == pytest.approx({size: 8, size // 20: 20, 1: n}[per_task], rel=0.3)
    assert warc.read_archives(listing, str(tmp_path), bytes_per_task=size // 20).agg(F.count_distinct("page_id")).first()[0] == 4000


def test_files_of_failed_attempts_are_removed(spark, tmp_path):
    pages = spark.range(50).selectExpr("id as page_id", "'u' as url", "'x' as html")
    first, second = warc.write_archives(pages, str(tmp_path)), warc.write_archives(pages, str(tmp_path))
    (tmp_path / "left-behind.warc.zst").write_bytes(b"half an archive")
    (tmp_path / "notes.txt").write_text("not ours")
    assert warc.remove_unlisted(str(tmp_path), first, second) == 1
    assert warc.read_archives(first, str(tmp_path)).count() == warc.read_archives(second, str(tmp_path)).count() == 50
    assert (tmp_path / "notes.txt").exists() and warc.remove_unlisted(str(tmp_path), first) == second.count()


@pytest.fixture(scope="module")
def sampler():
    return sampling.Sampler(queries.tokenizer_file("piece_bpe_32k.model"))


def all_segmentations(sampler, text):
    marked = sampling.SPACE + text.replace(" ", sampling.SPACE)
    tables = list(map(sampler.lattice, sampling.UNIT.findall(marked)))

    def walk(u, at, ids, logp):
        if u == len(tables):
            yield tuple(ids), logp
        elif at == len(tables[u]):
            yield from walk(u + 1, 0, ids, logp)
        else:
            for end, own, p, _ in tables[u][at][1]:
                yield from walk(u, end, [*ids, *own], logp + p)

    return dict(walk(0, 0, [], 0.0))


def test_samples_are_distinct_and_follow_the_distribution(sampler):
    every = all_segmentations(sampler, "the it")
    assert abs(sum(map(np.exp, every.values())) - 1) < 1e-9
    first, pairs = collections.Counter(), 0
    n = 4000
    for seed in range(n):
        got = sampler.sample("the it", 3, seed)
        assert len({tuple(ids) for ids, _, _ in got}) == 3
        assert all(abs(every[tuple(ids)] - p) < 1e-9 and 0 < c <= 1 for ids, p, c in got)
        first[tuple(got[0][0])] += 1
        best = max(every, key=every.get)
        pairs += tuple(got[0][0]) != best and tuple(got[1][0]) == best
    for ids, logp in every.items():
        p = np.exp(logp)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # Without replacement: best second, after another first, as the rule of conditional draws has it.
    top = np.exp(max(every.values()))
    want = sum(np.exp(q) * top / (1 - np.exp(q)) for q in every.values() if np.exp(q) < top)
    assert abs(pairs / n - want) < 0.04
    few = sampler.sample("a", 500, 1)
    assert {tuple(i) for i, _, _ in few} == set(all_segmentations(sampler, "a")) and all(c == 1 for _, _, c in few)


@pytest.mark.parametrize("text", ["", " ", "a  b ", "é\U0001f600 日本", "x" * 3000, "tab\tnew\nline", "word " * 3000])
def test_samples_decode_to_the_text(sampler, text):
    got = sampler.sample(text, 3, 5)
    assert all(sampler.decode(ids) == text for ids, _, _ in got) and got == sampler.sample(text, 3, 5)


def segmentations(sampler, texts, k, seeds):
    row, rank, ids, offsets, log_p, inclusion = sampler.sample_many(texts, k, seeds)
    assert all(sampler.round_trips(texts, row, ids, offsets))
    out = [[] for _ in texts]
    for i, t in enumerate(row.tolist()):
        assert rank[i] == len(out[t])
        out[t].append((tuple(ids[offsets[i] : offsets[i + 1]].tolist()), log_p[i], inclusion[i]))
    return out


def test_batches_of_samples_are_distinct_and_follow_the_distribution(sampler):
    n, k = 20_000, 3
    every = all_segmentations(sampler, "the it")
    best = max(every, key=every.get)
    first, pairs, held, weight = collections.Counter(), 0, collections.Counter(), collections.Counter()
    for got in segmentations(sampler, ["the it"] * n, k, list(range(n))):
        assert len({ids for ids, *_ in got}) == k
        assert all(abs(every[ids] - p) < 1e-8 and 0 < c <= 1 for ids, p, c in got)
        first[got[0][0]] += 1
        pairs += got[0][0] != best and got[1][0] == best
        for ids, p, c in got:
            held[ids] += 1
            weight[ids] += np.exp(p) / c
    for ids, logp in every.items():
        p = np.exp(logp)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    top = np.exp(every[best])
    want = sum(np.exp(q) * top / (1 - np.exp(q)) for q in every.values() if np.exp(q) < top)
    assert abs(pairs / n - want) < 0.02
    # Shares divided by inclusion scores estimate the share of a segmentation, and all together one.
    assert abs(weight[best] / n - top) < 0.02 and abs(sum(weight.values()) / n - 1) < 0.03
    # The single search draws from the same distribution.
    alone = collections.Counter(tuple(ids) for seed in range(4000) for ids, *_ in sampler.sample("the it", k, seed))
    assert all(abs(held[ids] / n - alone[ids] / 4000) < 0.04 for ids in every)


def test_all_segmentations_of_a_small_text_come_out(sampler):
    for text in ("a", "it", "é", "\U0001f600"):
        every = all_segmentations(sampler, text)
        (got,) = segmentations(sampler, [text], len(every) + 5, [3])
        assert {ids for ids, *_ in got} == set(every) and all(c == 1 for *_, c in got)


def test_samples_do_not_depend_on_the_batch(sampler):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdeitnos  \u2581é日\U0001f600\t"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(150)] + ["", " ", "x" * 700 + " the", "word " * 3000, "the it", "the it"]
    seeds = [*range(len(texts) - 1), len(texts) - 2]
    together = segmentations(sampler, texts, 4, seeds)
    assert together[-1] == together[-2]
    assert all(len({ids for ids, *_ in got}) == len(got) for got in together)
    assert together[150] == [((), 0.0, 1.0)]
    sampler.lattices.clear()
    order = rng.permutation(len(texts))
    apart = {int(t): segmentations(sampler, [texts[t]], 4, [seeds[t]])[0] for t in order}
    assert [apart[t] for t in range(len(texts))] == together


def test_sampling_query_edges(spark):
    frame = spark.createDataFrame([(1, None), (1, "hi"), (None, "hi"), (1, "hi")], "k long, text string").withColumn("key", F.lit("clash"))
    file = queries.tokenizer_file("piece_bpe_32k.model")
    rows = sampling.sampled_segmentations(frame, ["k"], "text", file, k=2).collect()
    assert all(r.round_trip for r in rows) and len(rows) == 7
    assert sampling.sampled_segmentations(frame.limit(0), ["k"], "text", file).count() == 0


def test_packing_is_gapless_and_whole(spark, words):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 60, 200, 450, 700]))) for _ in range(300)]
    texts += ["", None, "don't <|endoftext|>  x", "a²3 \u0085 \x1c’s", "x" * 9000, texts[0], texts[0]]
    frame = spark.createDataFrame([(i if i % 50 else None, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    json_file, ranks = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken")
    rows = packing.packed(frame, json_file, ranks).collect()
    tokenizer = Tokenizer.from_file(json_file)
    pieces = collections.Counter()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i if i % 50 else None, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == pieces
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 1024
    counts = collections.Counter(r.length for r in rows)
    assert len(places) <= packing.least_sequences(counts, 1024) + 1
    assert packing.packed(frame.limit(0), json_file, ranks).count() == 0


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # best fit needs more than two pairs of ten can hold
    plan = packing.complete(counts, 10)
    used = collections.Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 10
        used.update({x: c * n for x, c in collections.Counter(pattern).items()})
    assert used == collections.Counter(counts) and sum(n for _, n in plan) == 4


def test_fillings_are_undominated_and_the_fullest_comes_first():
    for seed in range(200):
        rng = random.Random(seed)
        lengths = sorted(rng.sample(range(1, 12), 4))
        counts = {x: rng.randint(0, 4) for x in lengths}
        room = rng.randint(0, 25)
        found = packing.fillings(room, counts, lengths, 3)
        for filling in found:
            used = collections.Counter(filling)
            assert all(used[x] <= counts[x] for x in used)
            assert not any(x <= room - sum(filling) and used[x] < counts[x] for x in lengths)
        every = itertools.product(*(range(counts[x] + 1) for x in lengths))
        sums = [sum(x * n for x, n in zip(lengths, times)) for times in every]
        assert sum(found[0]) == max(s for s in sums if s <= room)


def test_fillings_of_very_many_small_pieces_need_no_deep_stack():
    assert sum(packing.fillings(1023, {1: 5000, 2: 1}, [1, 2], 3)[0]) == 1023


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = corpus_pipeline.exact_copies(spark, docs, small_dir)
    assert set(exact.columns) == set(docs.columns)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t.lower() if t.isascii() else t].append(i)
    assert exact.count() <= len(groups)
    masked = {r.doc_id: r for r in corpus_pipeline.masked_secrets(spark, docs, small_dir).collect()}
    assert len(masked) == len(texts)
    for i, r in masked.items():
        if base_spans(texts[i]):
            assert "[SECRET]" in r.text and r.n_chars == len(r.text) and not [s for s in base_spans(r.text) if s.startswith("hex")]
        elif "[SECRET]" not in r.text:
            assert r.text == texts[i]
    final = corpus_pipeline.run(spark, small_dir)
    assert final.count() > 0 and set(final.toPandas().doc_id) <= set(texts)
