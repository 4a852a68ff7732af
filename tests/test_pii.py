"""Golden messages and quirks of the redaction."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgscreen import ScreenConfig, anonymize, explode_entities
from msgscreen.functions import fixed_values as fv
from msgscreen.operators import anonymize as an
from msgscreen.operators import pii, spans

STRICT = ScreenConfig(mode="strict")

GOLDEN = [
    (
        "My name is John Smith and my email is john@example.com. Can you help me?",
        "My name is John Smith and my email is [EMAIL_ADDRESS_0]. Can you help me?",
        [("EMAIL_ADDRESS", "john@example.com"), ("PERSON", "John Smith and my email is john")],
    ),
    (
        "mail a@b.co then a@b.co",
        "mail [EMAIL_ADDRESS_0] then [EMAIL_ADDRESS_0]",
        [("EMAIL_ADDRESS", "a@b.co"), ("EMAIL_ADDRESS", "a@b.co")],
    ),
    ("ssn 123-45-6789", "ssn [US_SSN_0]", [("US_SSN", "123-45-6789")]),
    (
        "call 555-1234 or +1 (415) 555-2671",
        "call[PHONE_NUMBER_0] or +[PHONE_NUMBER_1]",
        [("PHONE_NUMBER", " 555-1234"), ("PHONE_NUMBER", "1 (415) 555-2671")],
    ),
    ("card 4785380592391139", "card [CREDIT_CARD_0]", [("CREDIT_CARD", "4785380592391139")]),
    (
        "card 4111-1111-1111-1111",
        "card 4111-[PHONE_NUMBER_0]-1111",
        [("PHONE_NUMBER", "1111-1111"), ("CREDIT_CARD", "4111-1111-1111-1111")],
    ),
    (
        "card 1111-1111-1111-1111",
        "card [PHONE_NUMBER_0]-[PHONE_NUMBER_0]",
        [("PHONE_NUMBER", "1111-1111"), ("PHONE_NUMBER", "1111-1111"), ("CREDIT_CARD", "1111-1111-1111-1111")],
    ),
    (
        "Hello, I'm Priya. Call me PERSON now",
        "Hello, I'm [PERSON_0]. Call me [PERSON_1]",
        [("PERSON", "Priya"), ("PERSON", "PERSON now"), ("PERSON", "Priya")],
    ),
    ("hi there, this is fine", "hi [PERSON_1], this is [PERSON_0]", [("PERSON", "fine"), ("PERSON", "there")]),
    ("hello world", "hello [PERSON_0]", [("PERSON", "world")]),
    ("nothing to see", "nothing to see", []),
    # A pipe is a letter of the top-level domain.
    ("mail a@b.c|m ok", "mail [EMAIL_ADDRESS_0] ok", [("EMAIL_ADDRESS", "a@b.c|m")]),
    # A typed token takes the value of its type and keeps the real one in clear.
    ("keep [PERSON_0] my name is Bob", "keep [PERSON_0] my name is Bob", [("PERSON", "Bob")]),
    # A typed token without any value, twice: one entity.
    ("[ORDER_7] and [ORDER_7]", "[ORDER_7] and [ORDER_7]", [("ORDER", fv.REDACTED_VALUE)]),
    # Both a typed token and a fallback of another type.
    ("[ORDER_7] a@b.co", "[ORDER_7] [EMAIL_ADDRESS_0]", [("ORDER", fv.REDACTED_VALUE), ("EMAIL_ADDRESS", "a@b.co")]),
]


@pytest.mark.parametrize("text,redacted,entities", GOLDEN)
def test_golden(one, text, redacted, entities):
    row = one(anonymize, text)
    assert row.sanitized_text == redacted
    assert [(e.type, e.value) for e in row.entities] == entities


def test_entity_tokens_and_sources(one):
    row = one(anonymize, "mail a@b.co then c@d.co [ORDER_7]")
    assert [(e.token, e.source) for e in row.entities] == [
        ("[ORDER_7]", "pii"),
        ("[EMAIL_ADDRESS_0]", "regex_fallback"),
        ("[EMAIL_ADDRESS_1]", "regex_fallback"),
    ]


@pytest.mark.parametrize(
    "text,phones",
    [("é555-1234 x", []), ("x 555-1234", [" 555-1234"]), ("x ٥٥٥-1234", [" ٥٥٥-1234"])],
)
def test_unicode_phones(one, text, phones):
    assert one(lambda d: d.select(pii.phones("message").alias("v")), text).v == phones


def test_unicode_ssn_and_card(one):
    arabic = "١٢٣-٤٥-٦٧٨٩"
    assert one(lambda d: d.select(pii.ssns("message").alias("v")), f"x {arabic} y").v == [arabic]
    card = "4111\u00a01111\u00a01111\u00a01111"
    assert one(lambda d: d.select(pii.cards("message").alias("v")), card).v == [card]


def test_null_text(one):
    row = one(anonymize, None)
    assert row.sanitized_text is None and row.entities == []


def test_strict_follows_the_documented_example(one):
    row = one(lambda d: anonymize(d, STRICT), GOLDEN[0][0])
    assert row.sanitized_text == "My name is [PERSON_0] and my email is [EMAIL_ADDRESS_0]. Can you help me?"


def test_strict_closes_the_typed_token_gap(one):
    row = one(lambda d: anonymize(d, STRICT), "keep [PERSON_0] my name is Bob")
    assert row.sanitized_text == "keep [PERSON_0] my name is [PERSON_0]"
    assert [e.value for e in row.entities] == ["Bob"]


def test_strict_prefers_the_longest_span(one):
    row = one(lambda d: anonymize(d, STRICT), "card 4111-1111-1111-1111")
    assert row.sanitized_text == "card [CREDIT_CARD_0]"


def test_recognizer_runs_ahead_of_the_supplement(one):
    row = one(lambda d: anonymize(d, ScreenConfig(recognizers=("ip",))), "from 10.0.0.7 mail a@b.co")
    assert row.sanitized_text == "from [IP_ADDRESS_0] mail [EMAIL_ADDRESS_0]"
    assert [e.source for e in row.entities] == ["pii", "regex_fallback"]


def test_supplement_is_left_out_for_types_already_bound(one):
    """A weak phone is cut from the spans, and the bound one keeps the supplement from replacing it."""
    row = one(lambda d: anonymize(d, ScreenConfig(recognizers=("phone",))), "a 555-1234 b 5551234")
    assert row.sanitized_text == "a[PHONE_NUMBER_0] b 5551234"


def test_unknown_recognizer_and_mode_are_refused(messages):
    with pytest.raises(ValueError):
        anonymize(messages("x"), ScreenConfig(recognizers=("nope",)))
    with pytest.raises(ValueError):
        ScreenConfig(mode="loose")


def test_explode_entities(messages):
    rows = explode_entities(anonymize(messages("a@b.co and c@d.co", "none")), "msg_id").collect()
    assert sorted((r.msg_id, r.seq, r.value) for r in rows) == [("0", 0, "a@b.co"), ("0", 1, "c@d.co")]


# --- spans ------------------------------------------------------------------
def make_spans(spark, found):
    df = spark.createDataFrame([(found,)], f"spans array<{spans.SPAN_FIELDS}>")
    return df.withColumn("kept", spans.resolve_overlaps("spans"))


def brute_force_overlaps(found):
    kept = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


span_list = st.lists(
    st.tuples(st.integers(0, 30), st.integers(1, 12), st.sampled_from(["A", "B"])).map(
        lambda t: (t[0], t[0] + t[1], t[2], 0.5, "v")
    ),
    max_size=10,
    unique=True,
)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(found=span_list)
def test_overlaps_like_brute_force(spark, found):
    row = make_spans(spark, found).first()
    assert [tuple(s) for s in row.kept] == brute_force_overlaps(found)


ALPHABET = st.sampled_from(
    ["a@b.co", "555-1234", "123-45-6789", "4111 1111 1111 1111", "my name is Ann", " ", "é", "😀", "[X_1]", ", ", "word", "10.0.0.1"]
)
TEXTS = st.lists(ALPHABET, max_size=12).map(" ".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXTS, min_size=1, max_size=8))
def test_span_offsets_cut_out_their_value(messages, texts):
    df = spans.with_spans(
        messages(*texts), "message", spans.named_recognizers(spans.STANDARD_RECOGNIZERS + ("ip",))
    )
    for row in df.collect():
        for s in row.spans:
            assert row.message[s.start : s.end] == s.value


def python_redaction(text):
    """The regex-only rule written for one text, to compare with."""
    values = {
        "EMAIL_ADDRESS": re.findall(fv.EMAIL_PATTERN, text),
        "PHONE_NUMBER": re.findall(fv.PHONE_PATTERN, text),
        "US_SSN": re.findall(fv.SSN_PATTERN, text),
        "CREDIT_CARD": re.findall(fv.CARD_PATTERN, text),
        "PERSON": [n for p in (fv.NAME_INTRO_PATTERN, fv.NAME_GREETING_PATTERN) for n in re.findall(p, text, re.I)],
    }
    typed = {m[0] for m in re.findall(fv.TOKEN_PATTERN, text)}
    for name, found in values.items():
        if name in typed and found:
            continue
        for i, value in enumerate(found):
            text = text.replace(value, f"[{name}_{i}]")
    return text


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXTS, min_size=1, max_size=8))
def test_redaction_like_brute_force(messages, texts):
    for row in anonymize(messages(*texts)).collect():
        assert row.sanitized_text == python_redaction(row.message)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXTS, min_size=1, max_size=8))
def test_properties(messages, texts):
    once = anonymize(messages(*texts))
    for row in once.collect():
        tokens = [e.token for e in row.entities]
        assert len(tokens) == len(set(tokens))
    twice = anonymize(once.select("msg_id", F.col("sanitized_text").alias("message")))
    for row in twice.collect():
        assert not [e for e in row.entities if e.type == "EMAIL_ADDRESS" and e.source == "regex_fallback"]


def test_long_text_is_processed_whole(one):
    text = "word " * 40_000 + "mail end@example.com"
    row = one(anonymize, text)
    assert row.sanitized_text.endswith("mail [EMAIL_ADDRESS_0]")


def test_many_spans_in_one_text(one):
    """Thousands of spans in one text stay affordable and exact."""
    n = 3000
    text = " ".join(f"u{i}@example.com [ORDER_{i}]" for i in range(n))
    row = one(lambda d: anonymize(d, STRICT), text)
    assert row.sanitized_text == " ".join(f"[EMAIL_ADDRESS_{i}] [ORDER_{i}]" for i in range(n))
    row = one(anonymize, text)
    assert row.sanitized_text == " ".join(f"[EMAIL_ADDRESS_{i}] [ORDER_{i}]" for i in range(n))
    assert len(row.entities) == 2 * n


def test_each_pattern_is_evaluated_once(messages):
    plan = explode_entities(anonymize(messages("x")), "msg_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 7


def test_find_tokens(one):
    row = one(lambda d: d.select(an.find_tokens("message").alias("t")), "[A_1] x [b_1] [C_D_22] [E_]")
    assert row.t == ["[A_1]", "[C_D_22]"]


@pytest.mark.parametrize("mode", ["compat", "strict"])
@pytest.mark.parametrize("phrase", ["my name is ", "hello "])
@pytest.mark.parametrize("word", ["word ", "Word "])
def test_long_runs_of_words_after_a_name_phrase(one, mode, phrase, word):
    from msgscreen import ScreenConfig, scan

    text = phrase + word * 200_000
    row = one(lambda d: scan(d, ScreenConfig(mode=mode, max_message_chars=10_000_000)), text)
    assert row.token_count == len(text) // 4


def test_patterns_mean_the_same_under_every_parser_setting(spark, one):
    from msgscreen import scan

    text = "password: hunter22, mail a@b.co, ssn 123-45-6789, I'm Priya"
    before = one(scan, text)
    for setting in ("spark.sql.parser.escapedStringLiterals", "spark.sql.ansi.enabled"):
        old = spark.conf.get(setting)
        spark.conf.set(setting, "false" if old == "true" else "true")
        try:
            assert one(scan, text) == before and not before.allowed
        finally:
            spark.conf.set(setting, old)
