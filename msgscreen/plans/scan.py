"""The end-to-end scan: a table or stream of messages to one response per message.

One pass; no shuffle but that of the lexicon join. The length gate is a null text and not a second branch:
every pattern gives up at once on null, so over-long messages cost nothing and
the input is read a single time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions.text import model_input, token_count
from ..operators import handoff, plugins, routing, scores, secret_rules, secrets, toxicity_ml, verdict
from ..operators.anonymize import anonymize

def error_columns(models: dict) -> list[str]:
    """Only Python models can fail."""
    return ["scan_error"] if set(models) - {"toxicity_pipeline"} else []


RESPONSE_COLUMNS = (
    "allowed",
    "token_count",
    "scan_duration_ms",
    "original_prompt",
    "anonymized_prompt",
    "violations",
    "llm_handoff",
    "pii_scanner_error",
)


def too_long(config: ScreenConfig, text: str = "message") -> str:
    """Over-long messages are judged by their length alone."""
    return f"length({text}) > {config.max_message_chars}"


def gate(df: DataFrame, config: ScreenConfig = ScreenConfig(), text: str = "message") -> DataFrame:
    """Add ``char_count``, ``token_count``, ``too_long`` and the texts the scanners get."""
    over = too_long(config, text)
    return df.select(
        *df.columns,
        F.length(text).alias("char_count"),
        token_count(F.col(text)).alias("token_count"),
        F.expr(f"{over} as too_long"),
        F.expr(f"case when not ({over}) then {text} end as scan_text"),
    ).withColumn("model_text", model_input(F.col("scan_text"), config.model_input_chars))


def detect(
    df: DataFrame,
    config: ScreenConfig = ScreenConfig(),
    lexicon: DataFrame | None = None,
    injection_model: Callable | None = None,
    toxicity_model: Callable | None = None,
    span_model: Callable | None = None,
    toxicity_pipeline: PipelineModel | None = None,
) -> DataFrame:
    """Run all scanners over gated messages; adds findings and scores, one row each.

    ``lexicon`` is a table of ``word, weight`` (see ``learn_lexicon``).
    ``toxicity_pipeline`` is a fitted Spark ML model (see ``toxicity_ml``) that scores
    the model text on the JVM. ``injection_model`` and ``toxicity_model`` are loaders of
    ``text -> score``, ``span_model`` one of ``text -> [(type, start, end, score)]``, or
    of their batch forms. Without these three no row leaves the JVM. The toxicity score
    is the highest of all that are given.
    """
    found = scores.with_toxicity_score(df, "scan_text", lexicon, in_row=config.lexicon_in_row)
    found = secret_rules.with_rule_risk(found, "scan_text", config.secret_rules, "_rule_risk").withColumns(
        {
            "_secret_types": secrets.secret_types("scan_text"),
            "_extra_risk": F.greatest("_rule_risk", secrets.extra_risk("scan_text", config.extra_secret_rules)),
            "injection_score": scores.injection_score("scan_text", config.injection_rules),
        }
    )
    if toxicity_pipeline is not None:
        found = toxicity_ml.with_model_score(found, "model_text", toxicity_pipeline, "_learned")
        found = found.withColumn("toxicity_score", F.expr("greatest(toxicity_score, coalesce(_learned, 0D))"))
    scan_errors = []
    for name, model in (("injection", injection_model), ("toxicity", toxicity_model)):
        if model is not None:
            result = f"_{name}"
            found = found.withColumn(result, plugins.model_score(F.col("model_text"), model))
            found = found.withColumn(
                f"{name}_score", F.expr(f"greatest({name}_score, coalesce({result}.score, 0D))")
            )
            scan_errors.append(f"{result}.error")

    pii_error, plugin_spans = "cast(null as string)", None
    if span_model is not None:
        found = found.withColumn("_spans", plugins.model_spans(F.col("scan_text"), span_model))
        found = found.withColumn("_plugin_spans", F.col("_spans.spans"))
        pii_error, plugin_spans = "_spans.error", "_plugin_spans"
    found = anonymize(found, config, "scan_text", plugin_spans)
    found = found.withColumn("_secrets", secrets.secret_verdict("_secret_types", "_extra_risk"))

    # A row whose PII scanner failed counts as unscanned for PII; what the other scanners found stays.
    def if_scanned(column: str, name: str) -> str:
        return f"case when {pii_error} is null then {column} end as {name}" if span_model else f"{column} as {name}"

    return found.selectExpr(
        *df.columns,
        if_scanned("sanitized_text", "sanitized_text"),
        if_scanned("entities", "entities"),
        "_secrets as secrets",
        "injection_score",
        "toxicity_score",
        f"{pii_error} as pii_scanner_error",
        f"coalesce({', '.join(scan_errors) or 'cast(null as string)'}) as scan_error",
    )


def decide(found: DataFrame, config: ScreenConfig = ScreenConfig(), text: str = "message") -> DataFrame:
    """Turn findings into the verdict columns."""
    flagged = found.withColumns(
        {
            "has_secrets": F.expr("coalesce(secrets.detected, false)"),
            "has_pii": F.expr("coalesce(size(entities) > 0, false)"),
            "has_injection": scores.over_threshold("injection_score", config.injection_threshold),
            "has_toxicity": scores.over_threshold("toxicity_score", config.toxicity_threshold),
        }
    )
    judged = flagged.withColumn("violations", verdict.violations())
    judged = judged.withColumn("primary_violation", verdict.primary_violation("violations"))
    return judged.select(
        "*",
        # A scanner that failed has cleared nothing.
        F.expr("primary_violation is null and pii_scanner_error is null and scan_error is null as allowed"),
        F.expr("cast(null as bigint) as scan_duration_ms"),
        F.col(text).alias("original_prompt"),
        F.expr("case when has_pii then sanitized_text end as anonymized_prompt"),
        handoff.handoff("primary_violation.type", "primary_violation.confidence", "char_count").alias("llm_handoff"),
        verdict.detected_threats("violations").alias("detected_threats"),
        verdict.risk_level("violations").alias("risk_level"),
        F.current_timestamp().alias("scanned_at"),
    )


def scan_wide(df: DataFrame, config: ScreenConfig = ScreenConfig(), lexicon: DataFrame | None = None, **models) -> DataFrame:
    """All intermediate columns beside the response, blank messages left out."""
    return decide(detect(gate(routing.accepted(df), config), config, lexicon, **models), config)


def scan(df: DataFrame, config: ScreenConfig = ScreenConfig(), lexicon: DataFrame | None = None, **models) -> DataFrame:
    """One response per non-blank message, with the input's key columns in front.

    ``df`` holds ``message`` and any key columns, as a table or a stream.
    """
    keys = [c for c in df.columns if c != "message"]
    extra = error_columns(models)
    return scan_wide(df, config, lexicon, **models).select(*keys, *RESPONSE_COLUMNS, *extra)


def scan_over_long(df: DataFrame, config: ScreenConfig = ScreenConfig(), **models) -> DataFrame:
    """The responses of ``scan`` to its over-long messages: no scanner gets a text, so patterns and lexicon fold away."""
    keys = [c for c in df.columns if c != "message"]
    none = F.lit(None).cast("string")
    gated = gate(df.where(too_long(config)), config).withColumns({"scan_text": none, "model_text": none})
    return decide(detect(gated, config, **models), config).select(*keys, *RESPONSE_COLUMNS, *error_columns(models))


def scan_distinct(df: DataFrame, config: ScreenConfig = ScreenConfig(), lexicon: DataFrame | None = None, **models) -> DataFrame:
    """The same responses with every distinct text scanned once; over-long ones, which no scanner sees, stay where they are.

    Costs two shuffles, so it pays for model plug-ins and heavily repeated
    traffic; the native scanners alone are cheaper than shuffling the texts.
    """
    from ..operators.dedup import per_distinct_text

    keys = [c for c in df.columns if c != "message"]
    extra = error_columns(models)

    def work(texts: DataFrame) -> DataFrame:
        return decide(detect(gate(texts, config), config, lexicon, **models), config).select(
            "_key", "_salts", "message", *RESPONSE_COLUMNS, *extra
        )

    rows = routing.accepted(df)
    out = per_distinct_text(rows.where(f"not ({too_long(config)})"), work).select(*keys, *RESPONSE_COLUMNS, *extra)
    return out.unionByName(scan_over_long(rows, config, **models))


def flatten(responses: DataFrame, *keys: str) -> DataFrame:
    """A response as scalar columns only, for tables that hold no nested types."""
    v = "violations"
    return responses.select(
        *keys,
        "allowed",
        "token_count",
        "original_prompt",
        "anonymized_prompt",
        F.array_join(f"{v}.type", ",").alias("violation_types"),
        F.array_join(f"{v}.action", ",").alias("violation_actions"),
        F.array_max(f"{v}.confidence").alias("max_confidence"),
        F.col("llm_handoff.violation_type").alias("handoff_type"),
        F.col("llm_handoff.confidence_label").alias("confidence_label"),
        F.col("llm_handoff.message_length_label").alias("message_length_label"),
        F.col("llm_handoff.suggested_tone").alias("suggested_tone"),
        F.col("llm_handoff.prompt_for_llm").alias("prompt_for_llm"),
        "pii_scanner_error",
    )
