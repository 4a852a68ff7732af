"""Full redaction of a table of messages: sanitized text plus entity list per row.

The work is a chain of projections over one scan of the input. Intermediate
columns keep each regular expression from being evaluated twice: the optimizer
leaves a projection alone when something expensive in it is referenced again.
What a lambda needs from its row is such a column too, referenced outside the
lambda as well; else it would be inlined and run again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions import fixed_values as fv
from ..functions.patterns import empty_array, find_all, holds_any, jvm_pattern, only_if, quoted
from . import pii, spans

ENTITY_FIELDS = "struct<type:string,value:string,token:string,source:string>"


def find_tokens(text: str) -> Column:
    """Redaction tokens standing in the text, typed ones included."""
    return F.expr(only_if(holds_any(text, "["), find_all(text, fv.TOKEN_PATTERN)))


def nth_of_kind(kinds: str) -> Column:
    """For each element how many equal ones stand before it."""
    return F.expr(
        f"""
        transform(array_sort(flatten(transform(array_distinct({kinds}),
          k -> transform(filter(transform({kinds}, (t, i) -> named_struct('i', i, 't', t)), p -> p.t = k),
            (p, n) -> named_struct('i', p.i, 'n', n))))), p -> p.n)"""
    )


def bind_tokens(tokens: str, types: str, nth: str, values: dict[str, str], numbered: str | None = None) -> Column:
    """Entities for the tokens in the text: the n-th token of a type takes its n-th value.

    ``numbered`` names the array of numbered spans; types that ``values`` does not
    list, such as those of a caller's recogniser, take their values from there.
    """
    cases = " ".join(f"when {quoted(t)} then get({c}, {nth}[i])" for t, c in values.items())
    own = f"get(transform(filter({numbered}, s -> s.type = {types}[i]), s -> s.value), {nth}[i])" if numbered else "null"
    return F.expr(
        f"""
        transform({tokens}, (t, i) -> named_struct(
          'type', {types}[i], 'value', coalesce(case {types}[i] {cases} end, {own}, {quoted(fv.REDACTED_VALUE)}),
          'token', t, 'source', 'pii'))"""
    )


def fallback_entities(types: str, values: dict[str, str]) -> Column:
    """Entities of every type no token was bound to, in type and value order."""
    per_type = [
        f"""case when array_contains({types}, {quoted(t)}) then {empty_array(ENTITY_FIELDS)}
        else transform({c}, (v, i) -> named_struct(
          'type', {quoted(t)}, 'value', v, 'token', concat('[{t}_', i, ']'), 'source', 'regex_fallback')) end"""
        for t, c in values.items()
    ]
    return F.expr(f"concat({', '.join(per_type)})")


def replace_values(text: str, entities: str) -> Column:
    """Replace each value everywhere, one after the other, in the text changed so far."""
    return F.expr(f"aggregate({entities}, {text}, (a, e) -> replace(a, e.value, e.token))")


def first_per_token(entities: str, tokens: str) -> Column:
    """The first entity of each token, order kept; ``tokens`` are those of the entities."""
    return F.expr(
        f"""case when size({tokens}) > 1
        then filter({entities}, (e, i) -> array_position({tokens}, e.token) = i + 1) else {entities} end"""
    )


def with_token_spans(
    df: DataFrame,
    recognizers: tuple[spans.Recognizer, ...],
    config: ScreenConfig = ScreenConfig(),
    text: str = "message",
    plugin_spans: str | None = None,
) -> DataFrame:
    """Add ``token_spans``: found, cut by score, freed of overlaps, numbered."""
    out = spans.with_spans(df, text, recognizers, "_found")
    if plugin_spans:
        out = out.withColumn("_found", F.expr(f"concat(_found, coalesce({plugin_spans}, {empty_array(spans.SPAN_FIELDS)}))"))
    return (
        out.withColumn("_scored", spans.score_filter("_found", config.span_score_threshold))
        .withColumn("_kept", spans.resolve_overlaps("_scored"))
        .withColumn("token_spans", spans.number_tokens("_kept"))
        .drop("_found", "_scored", "_kept")
    )


def anonymize(
    df: DataFrame,
    config: ScreenConfig = ScreenConfig(),
    text: str = "message",
    plugin_spans: str | None = None,
) -> DataFrame:
    """Add ``sanitized_text`` and ``entities`` (``array<struct<type,value,token,source>>``).

    ``text`` names the column to redact. ``plugin_spans`` names an
    ``array<span>`` column made by a recogniser of the caller (see
    ``operators.plugins``); its spans join those of the configured recognisers.
    Null text gives null text and no entities.
    """
    if config.mode == "strict":
        return _anonymize_strict(df, config, text, plugin_spans)
    return _anonymize_compat(df, config, text, plugin_spans)


def _anonymize_strict(df: DataFrame, config: ScreenConfig, text: str, plugin_spans: str | None) -> DataFrame:
    wanted = tuple(dict.fromkeys(spans.STANDARD_RECOGNIZERS + config.recognizers))
    out = with_token_spans(df, spans.named_recognizers(wanted), config, text, plugin_spans)
    entities = F.expr(
        "transform(token_spans, s -> named_struct('type', s.type, 'value', s.value, 'token', s.token, 'source', 'pii'))"
    )
    return out.select(
        *df.columns, spans.redact_spans(text, "token_spans").alias("sanitized_text"), entities.alias("entities")
    )


def _values_of(type_: str) -> Column:
    return F.expr(f"transform(filter(token_spans, s -> s.type = {quoted(type_)}), s -> s.value)")


def _anonymize_compat(df: DataFrame, config: ScreenConfig, text: str, plugin_spans: str | None) -> DataFrame:
    values = {t: f"_v_{t}" for t in pii.SUPPLEMENT_TYPES}
    out = df.withColumn("_digits", pii.has_digit(text))
    out = out.withColumns({values[t]: v for t, v in pii.supplement_values(text, "_digits").items()})

    redacted, numbered = text, None
    if config.recognizers or plugin_spans:
        numbered = "token_spans" if plugin_spans else None
        recognizers = spans.named_recognizers(config.recognizers)
        out = with_token_spans(out, recognizers, config, text, plugin_spans)
        types = dict.fromkeys(r.type for r in recognizers)
        if plugin_spans:
            types.update(dict.fromkeys(fv.SPAN_SCORES))
        merged = pii.merge_values({t: _values_of(t) for t in types}, {t: F.col(c) for t, c in values.items()})
        values, redacted = {t: f"_m_{t}" for t in merged}, "_redacted"
        out = out.withColumns(
            {redacted: spans.redact_spans(text, "token_spans")} | {values[t]: v for t, v in merged.items()}
        )

    out = out.withColumn("_tokens", find_tokens(redacted))
    kind = f"regexp_extract(t, {quoted(jvm_pattern(fv.TOKEN_PATTERN))}, 1)"
    out = out.withColumn("_types", F.expr(f"transform(_tokens, t -> {kind})"))
    out = out.withColumn("_nth", nth_of_kind("_types"))
    out = out.withColumns(
        {"_bound": bind_tokens("_tokens", "_types", "_nth", values, numbered), "_fallback": fallback_entities("_types", values)}
    )
    out = out.withColumn("_every", F.expr("concat(_bound, _fallback)"))
    # Fallback tokens are unique by construction; only tokens from the text can repeat.
    out = out.withColumn(
        "_every_tokens", F.expr(only_if("size(_bound) > 0", "transform(_every, e -> e.token)"))
    )
    return out.select(
        *df.columns,
        replace_values(redacted, "_fallback").alias("sanitized_text"),
        first_per_token("_every", "_every_tokens").alias("entities"),
    )


def explode_entities(df: DataFrame, *keys: str) -> DataFrame:
    """Long-form findings: one row per entity, ``seq`` from 0.

    The outer explode keeps the optimizer from guessing a filter on the array
    below the projection, which would evaluate every pattern a second time.
    """
    rows = df.select(*keys, F.posexplode_outer("entities").alias("seq", "e"))
    return rows.where("e is not null").select(*keys, "seq", "e.type", "e.value", "e.token", "e.source")
