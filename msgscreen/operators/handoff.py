"""Reply tone, instruction and the ready-made reply prompt of blocked messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.patterns import quoted
from ..functions.text import confidence_label, length_label


def _lookup(rows: tuple[tuple[str, str], ...], key: str, default: str) -> Column:
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in rows)
    return F.expr(f"coalesce(try_element_at(map({pairs}), coalesce(lower({key}), '')), {quoted(default)})")


def tone(violation_type: str) -> Column:
    return _lookup(fv.TONES, violation_type, fv.DEFAULT_TONE)


def instruction(violation_type: str) -> Column:
    return _lookup(fv.INSTRUCTIONS, violation_type, fv.DEFAULT_INSTRUCTION)


def handoff(violation_type: str, confidence: str, chars: str) -> Column:
    """Reply record, null without a blocking violation."""
    vtype = F.lower(violation_type)
    labels = (
        confidence_label(F.col(confidence)),
        length_label(F.col(chars)),
        tone(violation_type),
        instruction(violation_type),
    )
    record = F.struct(
        vtype.alias("violation_type"),
        labels[0].alias("confidence_label"),
        labels[1].alias("message_length_label"),
        labels[2].alias("suggested_tone"),
        F.format_string(fv.REPLY_PROMPT, vtype, *labels).alias("prompt_for_llm"),
    )
    return F.when(vtype.isNotNull(), record)
