"""Primary recognition: typed spans with offsets, scores, numbering and redaction.

Everything here stays inside the row. Spans of one message are an array folded
by higher-order functions, so a whole corpus is redacted without a shuffle and
no message depends on where another one lies.

A span is ``struct<start,end,type,score,value>``; offsets are code points,
zero-based, end exclusive. Functions take the names of columns, which must exist
as such: what a lambda reads is then evaluated once per row and not per element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.patterns import empty_array, find_all, gaps, matches, only_if, quoted

SPAN_FIELDS = "struct<start:int,end:int,type:string,score:double,value:string>"


@dataclass(frozen=True)
class Recognizer:
    """A pattern whose last group is the entity (group 0: the whole match).

    ``needs`` is a cheap pattern found in every text that matches; other texts
    skip the recogniser. Values that match ``weak_pattern`` are weak hits.
    """

    type: str
    pattern: str
    score: float
    group: int = 0
    weak_pattern: str | None = None
    needs: str | None = None


def phrase_ignoring_case(pattern: str) -> str:
    """Ignore case in the phrase before group 1 only, so a name ends where capitals end."""
    phrase, name = pattern.split("([", 1)
    return f"(?i:{phrase})([{name}"


RECOGNIZERS = {
    "email": Recognizer("EMAIL_ADDRESS", fv.EMAIL_PATTERN, fv.SPAN_SCORES["EMAIL_ADDRESS"], needs="@"),
    "phone": Recognizer(
        "PHONE_NUMBER", fv.PHONE_PATTERN, fv.SPAN_SCORES["PHONE_NUMBER"],
        weak_pattern=fv.BARE_DIGITS_PATTERN, needs=r"\d",
    ),
    "ssn": Recognizer("US_SSN", fv.SSN_PATTERN, fv.SPAN_SCORES["US_SSN"]),
    "card": Recognizer("CREDIT_CARD", fv.CARD_PATTERN, fv.SPAN_SCORES["CREDIT_CARD"]),
    "name_intro": Recognizer(
        "PERSON", phrase_ignoring_case(fv.NAME_INTRO_PATTERN), fv.SPAN_SCORES["PERSON"], group=1
    ),
    "name_greeting": Recognizer(
        "PERSON", phrase_ignoring_case(fv.NAME_GREETING_PATTERN), fv.SPAN_SCORES["PERSON"], group=1
    ),
    "ip": Recognizer("IP_ADDRESS", fv.IP_PATTERN, fv.SPAN_SCORES["IP_ADDRESS"], needs=r"\d\."),
}
STANDARD_RECOGNIZERS = ("email", "phone", "ssn", "card", "name_intro", "name_greeting")


def named_recognizers(names: tuple[str, ...]) -> tuple[Recognizer, ...]:
    unknown = [n for n in names if n not in RECOGNIZERS]
    if unknown:
        raise ValueError(f"unknown recognizers {unknown}; known: {sorted(RECOGNIZERS)}")
    return tuple(RECOGNIZERS[n] for n in names)


def with_spans(df: DataFrame, text: str, recognizers: tuple[Recognizer, ...], out: str = "spans") -> DataFrame:
    """Add the spans of all recognisers, one recogniser after the other, with exact offsets.

    The text between matches gives the offsets: a match starts after all gaps
    and matches before it. Matches become columns first, so that each pattern
    runs once per text, and again for gaps and groups only where it has matched.
    """
    if not recognizers:
        return df.withColumn(out, F.expr(empty_array(SPAN_FIELDS)))
    whole = {f"_whole{i}": r for i, r in enumerate(recognizers)}
    matched = df.withColumns({c: F.expr(_whole_matches(text, r)) for c, r in whole.items()})
    located = ", ".join(_located(text, r, c) for c, r in whole.items())
    return matched.withColumn(out, F.expr(f"concat({located})")).drop(*whole)


def _whole_matches(text: str, recognizer: Recognizer) -> str:
    found = find_all(text, recognizer.pattern)
    return only_if(matches(text, recognizer.needs), found) if recognizer.needs else found


def _located(text: str, r: Recognizer, whole: str) -> str:
    steps = f"""zip_with(slice({gaps(text, r.pattern)}, 1, size({whole})), {whole},
      (g, w) -> named_struct('step', length(g) + length(w), 'value', w))"""
    if r.group:
        value = find_all(text, r.pattern, r.group)
        steps = f"zip_with({steps}, {value}, (z, v) -> named_struct('step', z.step, 'value', v))"
    score = f"cast({r.score} as double)"
    if r.weak_pattern:
        score = f"if({matches('m.value', r.weak_pattern)}, cast({fv.WEAK_SPAN_SCORE} as double), {score})"
    located = f"""
    aggregate({steps}, named_struct('pos', 0, 'spans', {empty_array(SPAN_FIELDS)}),
      (a, m) -> named_struct('pos', a.pos + m.step, 'spans', concat(a.spans, array(named_struct(
        'start', a.pos + m.step - length(m.value), 'end', a.pos + m.step,
        'type', {quoted(r.type)}, 'score', {score}, 'value', m.value)))),
      a -> a.spans)"""
    return only_if(f"size({whole}) > 0", located, SPAN_FIELDS)


def score_filter(spans: str, threshold: float = fv.SPAN_SCORE_THRESHOLD) -> Column:
    return F.expr(f"filter({spans}, s -> s.score >= cast({threshold} as double))")


def _longest_first(spans: str) -> str:
    """Spans of one overlapping run without overlaps."""
    return f"""
    if(size({spans}) <= 1, {spans}, aggregate(
      array_sort(transform({spans}, s -> named_struct(
        'neg_len', s.start - s.end, 'start', s.start, 'type', s.type, 'span', s))),
      {empty_array(SPAN_FIELDS)},
      (kept, r) -> if(exists(kept, k -> k.start < r.span.end and r.span.start < k.end),
        kept, concat(kept, array(r.span)))))"""


def resolve_overlaps(spans: str) -> Column:
    """Keep the longest span of an overlap, then the earliest, then by type; sorted by start.

    Spans are read in text order and compared only within a run of overlapping
    ones, so a text with thousands of them does not compare all pairs.
    """
    return F.expr(
        f"""
        case when size({spans}) <= 1 then {spans} else array_sort(aggregate(
          array_sort({spans}),
          named_struct('run', {empty_array(SPAN_FIELDS)}, 'end', 0, 'done', {empty_array(SPAN_FIELDS)}),
          (a, s) -> if(s.start < a.end,
            named_struct('run', concat(a.run, array(s)), 'end', greatest(a.end, s.end), 'done', a.done),
            named_struct('run', array(s), 'end', s.end, 'done', concat(a.done, {_longest_first('a.run')}))),
          a -> concat(a.done, {_longest_first('a.run')}))) end"""
    )


def number_tokens(spans: str) -> Column:
    """Add ``token`` = ``[TYPE_n]``, n counted per type from 0, left to right; sorted by start."""
    return F.expr(
        f"""
        array_sort(flatten(transform(array_distinct(transform({spans}, s -> s.type)),
          t -> transform(filter({spans}, s -> s.type = t), (s, n) -> named_struct(
            'start', s.start, 'end', s.end, 'type', s.type, 'score', s.score, 'value', s.value,
            'token', concat('[', t, '_', n, ']'))))))"""
    )


def redact_spans(text: str, token_spans: str) -> Column:
    """The text with every span replaced by its token; spans sorted and disjoint."""

    def end_before(i: str) -> str:
        return f"coalesce(get({token_spans}, {i} - 1).end, 0)"

    return F.expr(
        f"""
        case when size({token_spans}) > 0 then concat(
          array_join(transform({token_spans}, (s, i) -> concat(
            substring({text}, {end_before('i')} + 1, s.start - {end_before('i')}), s.token)), ''),
          substring({text}, {end_before(f'size({token_spans})')} + 1, length({text})))
        else {text} end"""
    )
