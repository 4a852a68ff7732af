"""Redaction that can be undone: keyed tokens, a vault of their values, and the way back.

Plain tokens may also be typed by a user. A keyed token carries a few letters derived
from a secret and the message's key, so that only tokens made here are ever replaced,
each by its own value; whatever else looks like a token is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.patterns import quoted
from . import spans
from .anonymize import with_token_spans

KEYED_TOKEN = r"\[[A-Z_]+_[0-9]+:[0-9a-f]{12}\]"


def token_key(secret: str, key: str) -> Column:
    """Twelve hexadecimal digits of a digest of the secret and the message's key."""
    return F.substring(F.sha2(F.concat(F.lit(f"{len(secret)}:{secret}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 12)


def protect(df: DataFrame, secret: str, key: str = "msg_id", text: str = "message", config: ScreenConfig = ScreenConfig(mode="strict")) -> DataFrame:
    """Add ``protected_text`` and ``vault`` (``map<token,value>``): every span of the strict mode under a keyed token."""
    wanted = tuple(dict.fromkeys(spans.STANDARD_RECOGNIZERS + config.recognizers))
    out = with_token_spans(df, spans.named_recognizers(wanted), config, text)
    out = out.withColumn("_key", token_key(secret, key))
    keyed = "concat(left(s.token, length(s.token) - 1), ':', _key, ']')"
    # The test names the key outside the lambda as well; else its digest would be inlined and run for every span.
    renamed = f"case when length(_key) = 12 then transform(token_spans, s -> named_struct('start', s.start, 'end', s.end, 'type', s.type, 'score', s.score, 'value', s.value, 'token', {keyed})) end"
    out = out.withColumn("_renamed", F.expr(renamed))
    vault = F.expr("map_from_entries(transform(_renamed, s -> struct(s.token, s.value)))")
    return out.select(*df.columns, spans.redact_spans(text, "_renamed").alias("protected_text"), vault.alias("vault"))


def vault_rows(protected: DataFrame, *keys: str) -> DataFrame:
    """``token, value`` per stored value, with the key columns in front: the table to keep apart from the texts."""
    # An outer explode: else the optimizer would test the map below the projection and find all spans a second time.
    rows = protected.select(*keys, F.explode_outer("vault").alias("token", "value"))
    return rows.where("token is not null")


def restored(text: str, vault: str) -> Column:
    """The text with the vault's tokens replaced by their values, all at once: values are not searched again."""
    q = quoted(KEYED_TOKEN)
    pieces = f"zip_with(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0), (g, t) -> concat(g, coalesce({vault}[t], t, '')))"
    return F.expr(f"case when {vault} is null or not contains({text}, '[') then {text} else array_join({pieces}, '') end")


def restore(replies: DataFrame, vault: DataFrame, key: str = "msg_id", text: str = "reply", out: str = "restored") -> DataFrame:
    """Add ``out``: the reply with the values that its message's tokens stand for.

    ``vault`` holds ``key, token, value`` as of ``vault_rows``. Values of one message are
    gathered, not those of several; replies without a token take no part in the join.
    """
    by_message = vault.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("_vault"))
    marked = F.coalesce(F.col(text).rlike(KEYED_TOKEN), F.lit(False))
    joined = replies.where(marked).join(by_message, key, "left").withColumn(out, restored(text, "_vault")).drop("_vault")
    return joined.select(*replies.columns, out).unionByName(replies.where(~marked).withColumn(out, F.col(text)))
