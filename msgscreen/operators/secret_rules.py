"""A set of credential rules of our own beside the published patterns: chosen by literals, judged by entropy.

Each rule names the literal that all its matches hold. The first two or three
characters of every word of a text are looked up among those of the rules, at one
cost however many rules there are; a rule that is named there and whose literal
stands in the text runs its pattern. A match counts if its value passes the rule's
tests and is not too uniform: Shannon's entropy, in bits a character, tells keys from
placeholders such as ``xxxxxxxx``. The rules claim no parity with anybody's library;
an empty tuple switches them off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import find_all, quoted

# The beginnings of words; a rule's literal starts a word wherever its pattern matches.
WORD_STARTS = r"(?<![A-Za-z0-9])[A-Za-z0-9]{2,3}"


@dataclass(frozen=True)
class SecretRule:
    """One rule. ``pattern`` is case-sensitive and begins at a word boundary (or at a sign) with one of ``literals``.

    ``group`` is the group that holds the value; each of ``needs`` must occur in the
    value, whose entropy must reach ``min_entropy``; ``risk`` goes into the verdict.
    """

    name: str
    literals: tuple[str, ...]
    pattern: str
    group: int = 1
    min_entropy: float = 0.0
    needs: tuple[str, ...] = ()
    risk: float = 1.0

    def starts(self) -> tuple[str, ...]:
        return tuple(re.search("[A-Za-z0-9]{1,3}", x).group() for x in self.literals)


# Our own values: rules for connection strings and keys with well-known beginnings.
DEFAULT_RULES = (
    SecretRule(
        "CONNECTION_STRING",
        ("postgres", "mysql", "mariadb", "mongodb", "redis", "amqp", "mssql"),
        r"\b(?:postgres|postgresql|mysql|mariadb|mongodb|redis|rediss|amqp|amqps|mssql)(?:\+[a-z0-9]{1,20})?://[^\s:/@]{0,64}:([^\s/@]{1,128})@[A-Za-z0-9\[]",
        min_entropy=1.5,
    ),
    SecretRule("STORAGE_KEY", ("AccountKey=",), r"\bAccountKey=([A-Za-z0-9+/]{40,100}={0,2})", min_entropy=3.5),
    SecretRule("SHORT_API_KEY", ("sk-", "pk-", "rk-", "ak-"), r"\b(?:sk|pk|rk|ak)-([A-Za-z0-9]{8,15})\b", min_entropy=2.5, needs=("[0-9]", "[A-Za-z]")),
    SecretRule("PROJECT_API_KEY", ("sk-",), r"\bsk-(?:proj|ant|svcacct)-([A-Za-z0-9_-]{16,200})", min_entropy=3.0),
    SecretRule("PAYMENT_KEY", ("sk_", "rk_"), r"\b(?:sk|rk)_(?:live|test)_([A-Za-z0-9]{16,100})", min_entropy=3.0),
    SecretRule("CHAT_TOKEN", ("xox",), r"\bxox[abprs]-([A-Za-z0-9-]{10,200})", min_entropy=2.5, needs=("[0-9]",)),
    SecretRule("REPOSITORY_TOKEN", ("glpat-", "github_pat_"), r"\b(?:glpat-|github_pat_)([A-Za-z0-9_-]{16,200})", min_entropy=3.0),
    SecretRule("PACKAGE_TOKEN", ("npm_",), r"\bnpm_([A-Za-z0-9]{30,100})", min_entropy=3.0),
    SecretRule("MAIL_KEY", ("SG.",), r"\bSG\.([A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64})", min_entropy=3.0),
    SecretRule("MODEL_HUB_TOKEN", ("hf_",), r"\bhf_([A-Za-z0-9]{30,60})", min_entropy=3.0),
    SecretRule("SIGNED_TOKEN", ("eyJ",), r"\beyJ[A-Za-z0-9_-]{8,200}\.eyJ[A-Za-z0-9_-]{8,900}\.([A-Za-z0-9_-]{16,900})", min_entropy=3.0),
    SecretRule("PRIVATE_KEY", ("BEGIN ",), r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", group=0),
)


def entropy(value: str) -> str:
    """Bits a character, to six places; 0 for an empty text."""
    share = f"(length({value}) - length(replace({value}, c, ''))) / length({value})"
    return f"""round(coalesce(aggregate(array_distinct(split({value}, '')), 0D,
      (sum, c) -> case when c = '' then sum else sum - {share} * log2({share}) end), 0D), 6)"""


def word_starts(text: str, rules: tuple[SecretRule, ...]) -> str:
    """Which of the rules' literals may begin a word of the text, as their first characters."""
    known = sorted({s for r in rules for s in r.starts()})
    found = f"regexp_extract_all({text}, {quoted(WORD_STARTS)}, 0)"
    return f"coalesce(array_intersect(array({', '.join(map(quoted, known))}), {found}), cast(array() as array<string>))"


def values(text: str, starts: str, rule: SecretRule) -> str:
    """The values of one rule's matches that pass; its pattern runs only where the literals allow it."""
    due = " or ".join(
        f"(array_contains({starts}, {quoted(s)}) and contains({text}, {quoted(x)}))" for s, x in zip(rule.starts(), rule.literals)
    )
    tests = [f"rlike(v, {quoted(n)})" for n in rule.needs]
    if rule.min_entropy > 0:
        tests.append(f"{entropy('v')} >= {float(rule.min_entropy)}D")
    found = find_all(text, rule.pattern, rule.group)
    passed = f"filter({found}, v -> {' and '.join(tests)})" if tests else found
    return f"case when {due} then {passed} else cast(array() as array<string>) end"


def with_rule_risk(df: DataFrame, text: str, rules: tuple[SecretRule, ...], out: str) -> DataFrame:
    """Add the highest risk of the rules that find something, 0 for none and for a null text."""
    if not rules:
        return df.withColumn(out, F.lit(0.0))
    risks = [f"case when size({values(text, '_word_starts', r)}) > 0 then {float(r.risk)}D else 0D end" for r in rules]
    ready = df.withColumn("_word_starts", F.expr(word_starts(text, rules)))
    nothing_due = "size(_word_starts) = 0"
    risk = F.expr(f"case when {nothing_due} then 0D else array_max(array({', '.join(risks)}, 0D)) end")
    return ready.withColumn(out, risk).drop("_word_starts")


def rule_findings(df: DataFrame, text: str, rules: tuple[SecretRule, ...] = DEFAULT_RULES, *keys: str) -> DataFrame:
    """``rule, seq, value, entropy`` per finding, with the key columns in front."""
    ready = df.select(*keys, F.col(text).alias("_text"), F.expr(word_starts(text, rules)).alias("_word_starts"))
    found = [f"transform({values('_text', '_word_starts', r)}, (v, i) -> named_struct('rule', {quoted(r.name)}, 'seq', i, 'value', v))" for r in rules]
    rows = ready.where("size(_word_starts) > 0").select(*keys, F.explode(F.expr(f"concat({', '.join(found)})")).alias("f"))
    return rows.select(*keys, "f.rule", "f.seq", "f.value").withColumn("entropy", F.expr(entropy("value")))
