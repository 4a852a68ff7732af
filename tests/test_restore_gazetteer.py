"""Restoring redacted values; phrases of a dictionary against a plain search."""

import random
import re

import pytest

from msgscreen.operators import gazetteer as gz
from msgscreen.operators import restore as rs


def protect_one(spark, text, secret="s", key="1"):
    return rs.protect(spark.createDataFrame([(key, text)], "msg_id string, message string"), secret).first()


TEXTS = [
    "My name is Priya Rao, mail a@b.co and a@b.co, ssn 123-45-6789",
    "keep [PERSON_0] and [ORDER_7], My name is Kenji",
    "card 4111-1111-1111-1111 call 555-1234",
    "no values [EMAIL_ADDRESS_0]",
    "[",
    "",
    None,
    "a@b.co" * 3,
]


def test_round_trip_of_replies(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "msg_id string, message string")
    protected = rs.protect(df, "secret")
    rows = {r.msg_id: r for r in protected.collect()}
    assert "Priya" not in rows["0"].protected_text and "a@b.co" not in rows["0"].protected_text
    assert "[PERSON_0]" in rows["1"].protected_text and "Kenji" not in rows["1"].protected_text
    replies = protected.selectExpr("msg_id", "concat('Re: ', protected_text, '!', protected_text) as reply")
    got = {r.msg_id: r.restored for r in rs.restore(replies, rs.vault_rows(protected, "msg_id")).collect()}
    assert got == {str(i): t if t is None else f"Re: {t}!{t}" for i, t in enumerate(TEXTS)}


def test_tokens_of_others_are_left_alone(spark):
    mine, other = protect_one(spark, "mail a@b.co"), protect_one(spark, "mail c@d.co", key="2")
    (token,) = mine.vault
    assert token not in other.vault and protect_one(spark, "mail a@b.co", secret="t").vault.keys() != mine.vault.keys()
    vault = spark.createDataFrame([("1", token, "a@b.co")], "msg_id string, token string, value string")
    replies = spark.createDataFrame([("1", f"{token} {next(iter(other.vault))} [EMAIL_ADDRESS_0]"), ("3", token)], "msg_id string, reply string")
    got = {r.msg_id: r.restored for r in rs.restore(replies, vault).collect()}
    assert got == {"1": f"a@b.co {next(iter(other.vault))} [EMAIL_ADDRESS_0]", "3": token}


def test_values_that_look_like_tokens_are_not_searched_again(spark):
    vault = spark.createDataFrame([("1", "[PERSON_0:0123456789ab]", "[PERSON_1:0123456789ab]"), ("1", "[PERSON_1:0123456789ab]", "x")], "msg_id string, token string, value string")
    replies = spark.createDataFrame([("1", "[PERSON_0:0123456789ab]")], "msg_id string, reply string")
    assert rs.restore(replies, vault).first().restored == "[PERSON_1:0123456789ab]"


def phrases_by_hand(text, known):
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    out, i = [], 0
    while i < len(words):
        best = None
        for n in range(1, 5):
            run = words[i : i + n]
            if len(run) < n or any(not re.fullmatch(r"\s+", text[a[1] : b[0]]) for a, b in zip(run, run[1:])):
                break
            if (key := " ".join(w[2] for w in run)) in known:
                best = (n, (run[0][0], run[-1][1], known[key], text[run[0][0] : run[-1][1]]))
        if best:
            out.append(best[1])
            i += best[0]
        else:
            i += 1
    return out


@pytest.fixture(scope="module")
def known(spark):
    rows = [("New York", "CITY"), ("york", "NAME"), ("New York City Hall", "PLACE"), ("straße", "WORD"), ("a-b", "PAIR"), ("  ", "BLANK"), (None, "NONE"), ("York", "AAA"), ("é1 中", "MIX")]
    return gz.dictionary(spark.createDataFrame(rows, "phrase string, type string"))


def test_longest_phrase_and_places(spark, known):
    kinds = {r.words: r.type for r in known.collect()}
    assert kinds == {"new york": "CITY", "york": "AAA", "new york city hall": "PLACE", "straße": "WORD", "a b": "PAIR", "é1 中": "MIX"}
    rng = random.Random(3)
    pieces = ["new", "New", "YORK", "york", "city", "hall", "straße", "a", "b", "é1", "中", "x", ".", "-", "🙂", "\n", "  "]
    texts = ["New  York City\nHall. new york, york a b a-b", "", "  ", None] + [
        "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.randint(1, 14))) for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted((r.id, r.start, r.end, r.type, r.value) for r in gz.find_phrases(df, known, "id", "t").collect())
    want = sorted((i, *hit) for i, t in enumerate(texts) for hit in phrases_by_hand(t or "", kinds))
    assert got == want and len(want) > 200


def test_empty_dictionary_and_long_text(spark, known):
    df = spark.createDataFrame([("1", "new york " * 20_000 + "x" * 1_000_000)], "msg_id string, message string")
    assert gz.find_phrases(df, known.limit(0)).count() == 0
    assert gz.find_phrases(df.selectExpr("msg_id", "concat(repeat('word ', 200000), message) as message").where("false"), known).count() == 0
    got = gz.find_phrases(spark.createDataFrame([("1", "word " * 200_000 + "new york")], "msg_id string, message string"), known).collect()
    assert [(r.start, r.value) for r in got] == [(1_000_000, "new york")]
