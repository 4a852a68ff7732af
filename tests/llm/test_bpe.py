"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from msgscreen.llm import bpe, queries

FILE = queries.tokenizer_file("byte_bpe_50k.json")
ALPHABET = "abcdeàéñ 0123.,'\n\t\r  ſß中文🙂\x1c\x85 s"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(FILE), words=50)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(library, encoder):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.1:
            text = f"{text}<|endoftext|>{text}<|endoftext"
        assert encoder.ids(text) == ids_of(library, text)
        assert encoder.vocabulary.decoded(encoder.ids(text)) == text


def test_every_code_point(library, encoder):
    for lo in range(0, 0x110000, 256):
        text = " ".join(f"{chr(c)}a1{chr(c)}" for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000)
        assert encoder.ids(text) == ids_of(library, text)


def test_tree_merges_leftmost_lowest_rank():
    """Against a scan over all pairs, on made-up merges in which a later pair may outrank an earlier one."""
    rng = random.Random(2)
    for _ in range(300):
        merges, n = {}, 4
        for rank in rng.sample(range(40), 12):
            merges.setdefault((rng.randrange(n), rng.randrange(n)), (rank, n))
            n += 1
        symbols = [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        plain = list(symbols)
        while found := [(merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merges]:
            i = min(found)[1]
            plain[i : i + 2] = [merges[plain[i], plain[i + 1]][1]]
        assert bpe.merged(symbols, merges) == plain


@pytest.mark.parametrize("unit", [" ", "\n", "a", " \n\t", "acgtgca", "é中"])
def test_very_long_words(library, encoder, unit):
    text = unit * (400_000 // len(unit))
    assert encoder.ids(text) == ids_of(library, text)


def test_query_on_hard_rows(spark, library, tmp_path):
    texts = [None, "", " ", "Hello <|endoftext|> world", "x" * 5000, "déjà vu 中文 🙂\r\n", "twice", "twice"]
    rows = [(i if i != 6 else None, t, "kept", [i]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, ids_of array<int>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_bpe(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for doc_id, text, *_ in rows:
        ids = ids_of(library, text or "")
        assert found[doc_id].n_tokens == len(ids)
        assert found[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.decoded(bpe.encoded(docs, FILE), FILE).collect()
    assert sorted(((r.doc_id or -1), r.text, r.kept, r.ids_of) for r in whole) == sorted(((i or -1), t or "", k, x) for i, t, k, x in rows)
    assert bpe.encoded(docs.limit(0), FILE).count() == 0


def test_unusual_ids_and_names(spark):
    tokens = spark.createDataFrame([(None,), ([],), ([464, None, 10**6],), ([20046, 50256],)], "ids array<int>")
    texts = [r.text for r in bpe.decoded(tokens, FILE).collect()]
    assert texts[:3] == ["", "", "The"] and texts[3].endswith("<|endoftext|>")
    with pytest.raises(ValueError):
        bpe.decoded(tokens.withColumnRenamed("ids", "text"), FILE, ids_col="text")
