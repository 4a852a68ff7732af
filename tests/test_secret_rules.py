"""Credential rules: kinds, placeholders, the keyword gate against running every pattern."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from msgscreen import ScreenConfig, scan
from msgscreen.operators import secret_rules as sr

KEY = "4fJ9sKq2LmZ8xWv7TbN3cR6y"


def found(messages, text):
    return [(r.rule, r.value) for r in sr.rule_findings(messages(text), "message").collect()]


@pytest.mark.parametrize(
    "text,rules",
    [
        ("Here's my OpenAI key: sk-abc123xyz789. Can you use it for me?", ["SHORT_API_KEY"]),
        ("postgres://app:s3cr3t!@db.example.org/x", ["CONNECTION_STRING"]),
        ("use mongodb+srv://u:p4ssw0rd@cluster0.example.net now", ["CONNECTION_STRING"]),
        ("redis://:hunter22@cache:6379", ["CONNECTION_STRING"]),
        ("postgres://app:xxxx@db/x and postgres://localhost/x", []),
        ("sk-learnings task-abc123xyz789 sk-aaaaaaaaaa sk-12345678", []),
        (f"sk-proj-{KEY}", ["PROJECT_API_KEY"]),
        (f"sk_live_{KEY} rk_test_{'x' * 20}", ["PAYMENT_KEY"]),
        (f"xoxb-12-{KEY}", ["CHAT_TOKEN"]),
        (f"AccountKey={KEY}{KEY}==", ["STORAGE_KEY"]),
        (f"glpat-{KEY}", ["REPOSITORY_TOKEN"]),
        (f"github_pat_{KEY}", ["REPOSITORY_TOKEN"]),
        (f"npm_{KEY}{KEY[:6]}", ["PACKAGE_TOKEN"]),
        (f"SG.{KEY}.{KEY}", ["MAIL_KEY"]),
        (f"hf_{KEY}{KEY[:6]}", ["MODEL_HUB_TOKEN"]),
        (f"eyJhbGciOiJI.eyJzdWIiOiIx.{KEY}", ["SIGNED_TOKEN"]),
        ("-----BEGIN OPENSSH PRIVATE KEY-----", ["PRIVATE_KEY"]),
        ("-----BEGIN PUBLIC KEY-----", []),
        ("nothing", []),
        ("", []),
        (None, []),
    ],
)
def test_kinds(messages, text, rules):
    assert [r for r, _ in found(messages, text)] == rules


def plain_entropy(v):
    return round(-sum(n / len(v) * math.log2(n / len(v)) for n in collections.Counter(v).values()), 6) if v else 0.0


def test_gate_changes_nothing(spark):
    """Against every pattern over every text, on texts made of pieces of credentials."""
    rng = random.Random(9)
    pieces = ["sk-", "sk_live_", "SG.", "eyJ", "é", "_", "postgres://", ":", "@", "h", KEY, KEY[:12], "xxxxxxxxxxxx", " ", "\n", "xoxb-", "AccountKey=",
              "-----BEGIN RSA PRIVATE KEY-----", "hf_", "npm_", "task-", "github_pat_", "glpat-", "redis", "s", "1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, message string")
    got = collections.Counter((r.i, r.rule, r.value, r.entropy) for r in sr.rule_findings(df, "message", sr.DEFAULT_RULES, "i").collect())
    want = collections.Counter()
    for i, text in enumerate(texts):
        for rule in sr.DEFAULT_RULES:
            for m in re.finditer(rule.pattern, text):
                value = m.group(rule.group)
                if all(re.search(n, value) for n in rule.needs) and plain_entropy(value) >= rule.min_entropy:
                    want[i, rule.name, value, plain_entropy(value)] += 1
    assert got == want and len(want) > 300


def test_scan_blocks_and_switch(messages):
    df = messages("Here's my OpenAI key: sk-abc123xyz789. Can you use it for me?", "fine")
    first, second = sorted(scan(df).collect(), key=lambda r: r.msg_id)
    assert not first.allowed and [tuple(v) for v in first.violations] == [("secrets", 1.0, "blocked")] and second.allowed
    assert all(r.allowed for r in scan(df, ScreenConfig(secret_rules=())).collect())


def test_own_rules_and_many_of_them(messages):
    own = tuple(sr.SecretRule(f"R{i}", (f"k{i:03d}-",), rf"\bk{i:03d}-([a-z]+)", risk=0.5 + i / 1000) for i in range(200))
    df = messages("k007-abc and k150-x", "K007-abc")
    rows = [r.risk for r in sr.with_rule_risk(df, "message", own, "risk").orderBy("msg_id").collect()]
    assert rows == [0.65, 0.0]


def test_long_texts_take_linear_time(spark):
    parts = ["sk-", "a", "postgres://", "eyJ", "xoxb-1", "A1 "]
    df = spark.createDataFrame([(p * (2_000_000 // len(p)),) for p in parts], "message string").repartition(6)
    sr.with_rule_risk(df, "message", sr.DEFAULT_RULES, "risk").agg(F.sum("risk")).collect()
