"""The registered queries restated as SQL for DuckDB, as an independent check.

The statements share named parts (``WITH`` entries). They are written for the
result alone: long tables, window functions and list folds where the Spark side
uses in-row arrays.
"""

from __future__ import annotations

import re

from ..functions import fixed_values as fv
from ..operators.secret_rules import DEFAULT_RULES
from ..operators.spans import RECOGNIZERS, STANDARD_RECOGNIZERS
from ..operators.gazetteer import WORD as PHRASE_WORD
from ..sources.messages import CREDENTIAL_MESSAGE_SQL, DERIVED_MESSAGE_SQL, EVENT_MESSAGE_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {q('(?i)' + pattern)}), false)"


def found(text: str, pattern: str, group: int = 0, ignore_case: bool = False) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"coalesce(regexp_extract_all({text}, {q(flag + pattern)}, {group}), [])"


VAULT_SECRET = "a secret of the caller"  # that of the registered query

MSGS = f"""
select concat('doc-', cast(doc_id as varchar)) as msg_id, source, cast(null as varchar) as session_id, text as message
from documents
union all
select concat('conv-', cast(conv_id as varchar), '-', cast(turn as varchar)), 'conversations',
 concat('conv', cast(conv_id as varchar)), text
from conversations
union all
select concat('cust-', cast(c_custkey as varchar)), 'customer', concat('cust', cast(c_custkey % 10 as varchar)),
 {DERIVED_MESSAGE_SQL.format(S='varchar')}
from customer
"""

CREDENTIAL_MSGS = f"""
select concat('part-', cast(p_partkey as varchar)) as msg_id, 'part' as source, concat('part', cast(p_partkey % 10 as varchar)) as session_id,
 {CREDENTIAL_MESSAGE_SQL.format(S='varchar')} as message
from part
"""

GATED = f"""
select *, substr(scan_text, 1, {fv.MODEL_INPUT_CHARS}) as model_text from (
 select *, cast(length(message) as int) as char_count,
  cast(greatest(1, length(message) // {fv.CHARS_PER_TOKEN}) as int) as token_count,
  length(message) > {fv.MAX_MESSAGE_CHARS} as too_long,
  case when length(message) <= {fv.MAX_MESSAGE_CHARS} then message end as scan_text
 from msgs)
"""

NAMES = "list_concat({}, {})".format(
    found("txt", fv.NAME_INTRO_PATTERN, 1, True), found("txt", fv.NAME_GREETING_PATTERN, 1, True)
)
SUPPLEMENT = (
    ("EMAIL_ADDRESS", found("txt", fv.EMAIL_PATTERN)),
    ("PHONE_NUMBER", found("txt", fv.PHONE_PATTERN)),
    ("US_SSN", found("txt", fv.SSN_PATTERN)),
    ("CREDIT_CARD", found("txt", fv.CARD_PATTERN)),
    ("PERSON", NAMES),
)

SECRET_LIST = "list_filter([{}], lambda x: x is not null)".format(
    ", ".join(f"case when {hit('txt', p)} then {q(t)} end" for t, p in fv.SECRET_PATTERNS)
)

ENTROPY = (
    "round(coalesce(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: "
    "(length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))), 0), 6)"
)


def rule_values(text: str, rule) -> str:
    """Values of a credential rule: its pattern over the whole text, then the tests."""
    tests = [f"regexp_matches(v, {q(n)})" for n in rule.needs] + [f"{ENTROPY} >= {rule.min_entropy}"]
    return f"list_filter({found(text, rule.pattern, rule.group)}, lambda v: {' and '.join(tests)})"


RULE_RISK = "greatest({}, cast(0 as double))".format(
    ", ".join(f"case when len({rule_values('scan_text', r)}) > 0 then cast({r.risk} as double) else cast(0 as double) end" for r in DEFAULT_RULES)
)

INJECTION = "case {} else cast(0 as double) end".format(
    " ".join(
        f"when {hit('scan_text', p)} then cast({w} as double)"
        for _, p, w in sorted(fv.INJECTION_RULES, key=lambda r: -r[2])
    )
)

LEXICON = f"""
select word, cast(t as bigint) as toxic_docs, cast(c as bigint) as clean_docs, weight from (
 select word, t, c,
  share * (n / (n + 1)) + 0.5 / (n + 1) - sqrt(share * (1 - share) * n + cast(0.25 as double)) / (n + 1) as weight
 from (
  select *, t / (t + c * (nt / greatest(nc, 1))) as share, t + c * (nt / greatest(nc, 1)) as n from (
  select word, cast(sum(toxic) as double) as t, cast(sum(1 - toxic) as double) as c from (
   select toxic, unnest(list_distinct(regexp_extract_all(lower(text), {q(fv.WORD_PATTERN)}))) as word
   from documents join labels using (doc_id))
  group by word),
  (select cast(sum(toxic) as double) as nt, cast(sum(1 - toxic) as double) as nc from labels)))
where t >= 5 and weight >= cast(0.8 as double)
"""

TOX = """
select msg_id, max(weight) as score from (
 select msg_id, unnest(regexp_extract_all(lower(scan_text), '\\p{L}+')) as w from gated)
join lexicon on w = word group by msg_id
"""


HELD_OUT = "cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 2)) as int) % 5 = 0"

# Naive Bayes by counting: per class the documents that hold a word, with one added to each count, over words
# whose shares in the two classes differ by three deviations.
BAYES_WORDS = f"""
select word, ln(c1 + 1) - ln(t1 + v) as w1, ln(c0 + 1) - ln(t0 + v) as w0 from (
 select word, c1, c0, sum(c1) over () as t1, sum(c0) over () as t0, count(*) over () as v from (
  select word, cast(sum(toxic) as double) as c1, cast(sum(1 - toxic) as double) as c0 from (
   select toxic, unnest(list_distinct(regexp_extract_all(lower(text), {q(fv.WORD_PATTERN)}))) as word
   from documents join labels using (doc_id) where not ({HELD_OUT}))
  group by word having count(*) >= 5),
  (select cast(sum(toxic) as double) as n1, cast(sum(1 - toxic) as double) as n0
   from documents join labels using (doc_id) where not ({HELD_OUT}))
 where abs(ln((c1 + 1) / (n1 + 2)) - ln((c0 + 1) / (n0 + 2))) / sqrt(1 / (c1 + 1) + 1 / (c0 + 1)) >= 3)
"""
BAYES = f"""
select g.msg_id, case when g.model_text is null then cast(0 as double)
 else 1 / (1 + exp(p0 + coalesce(s0, 0) - p1 - coalesce(s1, 0))) end as score
from gated g
left join (select msg_id, sum(w1) as s1, sum(w0) as s0 from (
  select msg_id, unnest(list_distinct(regexp_extract_all(lower(model_text), {q(fv.WORD_PATTERN)}))) as w from gated)
 join bayes_words on w = word group by msg_id) x on x.msg_id = g.msg_id,
(select ln(sum(toxic) + 1) - ln(count(*) + 2) as p1, ln(sum(1 - toxic) + 1) - ln(count(*) + 2) as p0
 from documents join labels using (doc_id) where not ({HELD_OUT}))
"""


def length_label(chars: str) -> str:
    cases = " ".join(f"when {chars} < {b} then {q(label)}" for b, label in fv.LENGTH_LABELS)
    return f"case {cases} else {q(fv.LENGTH_LABEL_REST)} end"


def confidence_label(score: str) -> str:
    cases = " ".join(f"when {score} >= cast({b} as double) then {q(label)}" for b, label in fv.CONFIDENCE_LABELS)
    return f"case {cases} else {q(fv.CONFIDENCE_LABEL_REST)} end"


def lookup(rows, key: str, default: str) -> str:
    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in rows)
    return f"case lower({key}) {cases} else {q(default)} end"


def spans(source: str, names) -> str:
    """Span rows of the named recognisers over ``source(msg_id, txt)``."""
    parts = []
    for name in names:
        r = RECOGNIZERS[name]
        score = f"cast({r.score} as double)"
        if r.weak_pattern:
            score = (
                f"case when regexp_matches(v, {q(r.weak_pattern)}) then cast({fv.WEAK_SPAN_SCORE} as double) "
                f"else {score} end"
            )
        parts.append(span_part(source, r.type, r.pattern, r.group, score))
    return " union all ".join(parts)


def span_part(source: str, type_: str, pattern: str, group: int, score: str) -> str:
    return f"""
select msg_id, {q(type_)} as type, cast(e - length(v) as int) as s, cast(e as int) as e, v, {score} as score from (
 select msg_id, val[i] as v, list_sum(list_transform(g[1:i], lambda x: length(x)))
   + list_sum(list_transform(m[1:i], lambda x: length(x))) as e from (
  select msg_id, m, val, g, unnest(range(1, len(m) + 1)) as i from (
   select msg_id, {found('txt', pattern)} as m, {found('txt', pattern, group)} as val,
    regexp_split_to_array(txt, {q(pattern)}) as g from {source}) where len(m) > 0))
"""


def redaction_parts(p: str, source: str, span_sql: str) -> dict[str, str]:
    """Score cut, overlap resolution, numbering and redaction as parts named after ``p``."""
    return {
        f"{p}_spans": span_sql,
        f"{p}_kept": f"""
select msg_id, k.s as s, k.e as e, k.t as t, k.v as v from (
 select msg_id, unnest(list_reduce(l, lambda a, x: case
   when len(list_filter(a, lambda b: b.s < x[1].e and x[1].s < b.e)) > 0 then a else list_concat(a, x) end)) as k
 from (select msg_id, list([{{'s': s, 'e': e, 't': type, 'v': v}}] order by e - s desc, s, type) as l
  from {p}_spans where score >= {fv.SPAN_SCORE_THRESHOLD} group by msg_id))
""",
        f"{p}_num": f"""
select *, concat('[', t, '_', cast(row_number() over (partition by msg_id, t order by s) - 1 as varchar), ']') as token
from {p}_kept
""",
        f"{p}_red": f"""
select msg_id, txt, case when built is null then txt else concat(built, substr(txt, last_end + 1)) end as red
from {source} left join (
 select msg_id, string_agg(concat(substr(txt, pe + 1, s - pe), token), '' order by s) as built, max(e) as last_end
 from (select n.*, txt, coalesce(lag(e) over (partition by n.msg_id order by s), 0) as pe
  from {p}_num n join {source} using (msg_id))
 group by msg_id) using (msg_id)
""",
    }


def anonymize_parts(p: str, source: str, primary_types=(), span_sql: str | None = None) -> dict[str, str]:
    """The whole redaction over ``source(msg_id, txt)``: parts ``{p}_ents`` and ``{p}_out``."""
    parts = {}
    if span_sql:
        parts.update(redaction_parts(p, source, span_sql))
    else:
        parts[f"{p}_red"] = f"select msg_id, txt, txt as red from {source}"
    supplement = dict(SUPPLEMENT)
    types = list(dict.fromkeys(list(primary_types) + list(supplement)))
    rows = []
    for k, t in enumerate(types):
        own = supplement.get(t, "cast([] as varchar[])")
        if t in primary_types:
            first = (
                f"coalesce((select list(v order by s) from {p}_num n where n.msg_id = r.msg_id and n.t = {q(t)}),"
                " cast([] as varchar[]))"
            )
            own = f"list_concat({first}, {own})"
        rows.append(f"select msg_id, {q(t)} as type, {k} as type_no, {own} as vals from {p}_red r")
    parts[f"{p}_vals"] = " union all ".join(rows)
    parts[f"{p}_tok"] = f"""
select msg_id, token, ord, regexp_extract(token, {q(fv.TOKEN_PATTERN)}, 1) as type from (
 select msg_id, unnest(toks) as token, unnest(range(len(toks))) as ord from (
  select msg_id, {found('red', fv.TOKEN_PATTERN)} as toks from {p}_red))
"""
    parts[f"{p}_bound"] = f"""
select k.msg_id, k.type, coalesce(vals[occ], {q(fv.REDACTED_VALUE)}) as value, token, ord from (
 select *, row_number() over (partition by msg_id, type order by ord) as occ from {p}_tok) k
left join {p}_vals v on v.msg_id = k.msg_id and v.type = k.type
"""
    parts[f"{p}_fall"] = f"""
select msg_id, type, type_no, i, vals[i + 1] as value, concat('[', type, '_', cast(i as varchar), ']') as token from (
 select msg_id, type, type_no, vals, unnest(range(len(vals))) as i from {p}_vals v
 where not exists (select 1 from {p}_tok k where k.msg_id = v.msg_id and k.type = v.type))
"""
    parts[f"{p}_ents"] = f"""
select msg_id, type, value, token, source,
 cast(row_number() over (partition by msg_id order by grp, o1, o2) - 1 as int) as seq from (
 select *, row_number() over (partition by msg_id, token order by grp, o1, o2) as nth from (
  select msg_id, type, value, token, 'pii' as source, 0 as grp, ord as o1, 0 as o2 from {p}_bound
  union all
  select msg_id, type, value, token, 'regex_fallback', 1, type_no, i from {p}_fall))
where nth = 1
"""
    parts[f"{p}_out"] = f"""
select r.msg_id, coalesce(n.n, 0) as n_entities, case when f.es is null then r.red else
 list_reduce(list_prepend({{'v': r.red, 'k': ''}}, f.es), lambda a, x: {{'v': replace(a.v, x.v, x.k), 'k': ''}}).v
 end as sanitized
from {p}_red r
left join (select msg_id, list({{'v': value, 'k': token}} order by type_no, i) as es from {p}_fall group by msg_id) f
 on f.msg_id = r.msg_id
left join (select msg_id, cast(count(*) as int) as n from {p}_ents group by msg_id) n on n.msg_id = r.msg_id
"""
    return parts


def wide(out: str, toxicity: bool, error: str = "cast(null as varchar)",
         injection_cut: float = fv.INJECTION_THRESHOLD, toxicity_cut: float = fv.TOXICITY_THRESHOLD,
         gated: str = "gated", rules: bool = True, scores: str = "tox") -> str:
    """Scores, flags and verdict per non-blank message; ``out`` names the redaction result."""
    rule_risk = "rule_risk" if rules else "cast(0 as double)"
    tox = "coalesce(x.score, cast(0 as double))" if toxicity else "cast(0 as double)"
    join_tox = f"left join {scores} x on x.msg_id = g.msg_id" if toxicity else ""
    return f"""
select *, blocking[1] as primary_type,
 case blocking[1] when 'token_limit' then cast({fv.TOKEN_LIMIT_CONFIDENCE} as double) when 'secrets' then risk
  when 'injection' then injection_score when 'toxicity' then toxicity_score end as primary_confidence,
 len(blocking) = 0 and pii_error is null as allowed, case when has_pii then sanitized end as anonymized_prompt
from (
 select *, list_filter(types, lambda t: t <> 'pii') as blocking from (
  select *, case when too_long then ['token_limit'] else list_filter([
    case when has_secrets then 'secrets' end, case when has_pii then 'pii' end,
    case when has_injection then 'injection' end, case when has_toxicity then 'toxicity' end],
    lambda x: x is not null) end as types
  from (
   select *, injection_score >= cast({injection_cut} as double) as has_injection,
    toxicity_score >= cast({toxicity_cut} as double) as has_toxicity,
    pii_error is null and coalesce(n_entities, 0) > 0 as has_pii,
    len(secret_list) > 0 or {rule_risk} > 0 as has_secrets,
    case when len(secret_list) > 0 then greatest({rule_risk}, cast(1 as double)) else {rule_risk} end as risk
   from (
    select g.*, o.sanitized, o.n_entities, {error} as pii_error, {tox} as toxicity_score,
     {INJECTION} as injection_score, {SECRET_LIST.replace('txt', 'scan_text')} as secret_list, {RULE_RISK} as rule_risk
    from {gated} g left join {out} o on o.msg_id = g.msg_id {join_tox}
    where regexp_matches(g.message, '\\S')))))
"""


FIRST_BAD_IP = (
    f"list_filter({found('scan_text', fv.IP_LIKE_PATTERN)}, lambda m: "
    "len(list_filter(string_split(m, '.'), lambda o: cast(o as int) > 255)) > 0)[1]"
)
PLUGIN_ERROR = f"concat('ValueError: impossible address ', {FIRST_BAD_IP})"
PLUGIN_ERROR = f"case when {FIRST_BAD_IP} is not null then {PLUGIN_ERROR} end"

ALL_NAMES = STANDARD_RECOGNIZERS + ("ip",)
ALL_TYPES = tuple(dict.fromkeys(RECOGNIZERS[n].type for n in ALL_NAMES))

# Runs of one to three words (all phrases of the table are that short), the leftmost and then the longest one kept.
PHRASES = """
select words, min(type) as type from (
 select array_to_string(list_transform(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+'), lambda w: lower(w)), ' ') as words, 'PRODUCT' as type from part
 union all
 select array_to_string(list_transform(regexp_extract_all(string_split(p_name, ' ')[-1], '[\\p{L}\\p{N}]+'), lambda w: lower(w)), ' '), 'THING' from part)
where words <> '' group by words
"""
PHRASE_HITS = f"""
select msg_id, s, e, type, substr(message, cast(s as bigint) + 1, cast(e - s as bigint)) as value from (
 select msg_id, message, x.s as s, x.e as e, type from (
  select msg_id, message, unnest(list_concat(
   list_transform(range(1, len(w) + 1), lambda i: {{'words': lower(w[i]), 's': st[i], 'e': st[i] + length(w[i])}}),
   list_concat(
    list_transform(list_filter(range(1, len(w)), lambda i: regexp_full_match(g[i + 1], '\\s+')),
     lambda i: {{'words': concat(lower(w[i]), ' ', lower(w[i + 1])), 's': st[i], 'e': st[i + 1] + length(w[i + 1])}}),
    list_transform(list_filter(range(1, len(w) - 1), lambda i: regexp_full_match(g[i + 1], '\\s+') and regexp_full_match(g[i + 2], '\\s+')),
     lambda i: {{'words': concat(lower(w[i]), ' ', lower(w[i + 1]), ' ', lower(w[i + 2])), 's': st[i], 'e': st[i + 2] + length(w[i + 2])}}))
  )) as x from (
   select msg_id, message, w, g, list_transform(range(1, len(w) + 1),
     lambda i: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda y: length(y))), 0)) as st
   from (select msg_id, message, regexp_extract_all(message, {q(PHRASE_WORD)}) as w, regexp_split_to_array(message, {q(PHRASE_WORD)}) as g
    from (select msg_id, message from msgs union all select msg_id, message from credential_msgs)
    where regexp_matches(lower(message), (select string_agg(words, '|') from phrases)))
   where len(w) > 0))
 join phrases p on p.words = x.words)
"""

EVENT_MSGS = f"""
select concat('event-', cast(event_id as varchar)) as msg_id, 'events' as source, concat('user', cast(user_id as varchar)) as session_id,
 {EVENT_MESSAGE_SQL.format(S='varchar')} as message, ts
from events
"""

# Held-out documents with the score of the naive Bayes model over their whole texts, in hundredths.
CURVE_BINS = f"""
select bin, count(*) as n, cast(sum(toxic) as bigint) as n_positive from (
 select toxic, cast(floor(round(1 / (1 + exp(p0 + coalesce(s0, 0) - p1 - coalesce(s1, 0))), 6) * 100) as int) as bin
 from documents join labels using (doc_id)
 left join (select doc_id as d, sum(w1) as s1, sum(w0) as s0 from (
   select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), {q(fv.WORD_PATTERN)}))) as w from documents)
  join bayes_words on w = word group by doc_id) x on x.d = doc_id,
 (select ln(sum(toxic) + 1) - ln(count(*) + 2) as p1, ln(sum(1 - toxic) + 1) - ln(count(*) + 2) as p0
  from documents join labels using (doc_id) where not ({HELD_OUT}))
 where {HELD_OUT})
group by bin
"""
# Isotonic regression by its formula: the largest over starts of the least over ends of the pooled share.
CURVE_POOLED = """
select bin, max(least_share) as calibrated from (
 select c.bin, a.bin as lo, min((select sum(n_positive) / cast(sum(n) as double) from curve_bins m where m.bin between a.bin and b.bin)) as least_share
 from curve_bins c join curve_bins a on a.bin <= c.bin join curve_bins b on b.bin >= c.bin group by c.bin, a.bin)
group by bin
"""

PARTS: dict[str, str] = {
    "msgs": MSGS,
    "phrases": PHRASES,
    "phrase_hits": PHRASE_HITS,
    "credential_msgs": CREDENTIAL_MSGS,
    "event_msgs": EVENT_MSGS,
    "event_gated": GATED.replace("from msgs", "from event_msgs"),
    "event_short": "select msg_id, scan_text as txt from event_gated",
    **anonymize_parts("event", "event_short"),
    "wide_event": wide("event_out", False, gated="event_gated"),
    "curve_bins": CURVE_BINS,
    "curve_pooled": CURVE_POOLED,
    "gated": GATED,
    "credential_gated": GATED.replace("from msgs", "from credential_msgs"),
    "credential_short": "select msg_id, scan_text as txt from credential_gated",
    "whole": "select msg_id, message as txt from msgs",
    "short": "select msg_id, scan_text as txt from gated",
    "lexicon": LEXICON,
    "tox": TOX,
    "bayes_words": BAYES_WORDS,
    "bayes": BAYES,
    **anonymize_parts("plain", "whole"),
    **anonymize_parts("ip", "whole", ("IP_ADDRESS",), spans("whole", ("ip",))),
    **anonymize_parts("every", "whole", ALL_TYPES, spans("whole", ALL_NAMES)),
    **anonymize_parts("scan", "short"),
    **redaction_parts("strict", "short", spans("short", ALL_NAMES)),
    **redaction_parts("keyed", "whole", spans("whole", ALL_NAMES)),
    "keyed_num": f"""
select *, concat('[', t, '_', cast(row_number() over (partition by msg_id, t order by s) - 1 as varchar), ':',
 substr(sha256(concat('{len(VAULT_SECRET)}:{VAULT_SECRET}:', msg_id)), 1, 12), ']') as token from keyed_kept
""",
    "strict_out": """
select r.msg_id, red as sanitized, coalesce(n, 0) as n_entities from strict_red r
left join (select msg_id, count(*) as n from strict_num group by msg_id) c on c.msg_id = r.msg_id
""",
    "good": f"select msg_id, case when {FIRST_BAD_IP} is null then scan_text end as txt from gated",
    **anonymize_parts("plug", "good", ("IP_ADDRESS",),
                      span_part("good", "IP_ADDRESS", fv.IP_LIKE_PATTERN, 0, "cast(0.6 as double)")),
    **anonymize_parts("credential", "credential_short"),
    "wide_credential": wide("credential_out", False, gated="credential_gated"),
    "wide_unruled": wide("credential_out", False, gated="credential_gated", rules=False),
    "wide": wide("scan_out", True),
    "wide_bare": wide("scan_out", False),
    "wide_bayes": wide("scan_out", True, scores="bayes"),
    "wide_cut": wide("scan_out", True, injection_cut=0.9, toxicity_cut=0.95),
    "wide_strict": wide("strict_out", False),
    "wide_plug": wide("plug_out", False, PLUGIN_ERROR),
}

PROMPT = "concat({})".format(
    ", ".join(
        piece
        for pair in zip(
            [q(x) for x in fv.REPLY_PROMPT.split("%s")],
            [
                "primary_type",
                confidence_label("primary_confidence"),
                length_label("char_count"),
                lookup(fv.TONES, "primary_type", fv.DEFAULT_TONE),
                lookup(fv.INSTRUCTIONS, "primary_type", fv.DEFAULT_INSTRUCTION),
                None,
            ],
        )
        for piece in pair
        if piece
    )
)


def blocked(expr: str) -> str:
    return f"case when primary_type is not null then {expr} end"


HANDOFF = f"""primary_type as {{}}, {blocked(confidence_label('primary_confidence'))} as confidence_label,
 {blocked(length_label('char_count'))} as message_length_label,
 {blocked(lookup(fv.TONES, 'primary_type', fv.DEFAULT_TONE))} as suggested_tone, {blocked(PROMPT)} as prompt_for_llm"""

ACTIONS = "list_transform(types, lambda t: case when t = 'pii' then 'anonymized' else 'blocked' end)"
CONFIDENCES = (
    f"list_transform(types, lambda t: case t when 'pii' then cast({fv.PII_CONFIDENCE} as double) "
    f"when 'injection' then injection_score when 'toxicity' then toxicity_score else cast(1 as double) end)"
)


def flat(source: str, keys: str) -> str:
    return f"""
select {keys}, allowed, token_count, message as original_prompt, anonymized_prompt,
 array_to_string(types, ',') as violation_types, array_to_string({ACTIONS}, ',') as violation_actions,
 list_max({CONFIDENCES}) as max_confidence, {HANDOFF.format('handoff_type')}, pii_error as pii_scanner_error
from {source}
"""


ROUTE = "case when pii_error is not null then 'hold' when not allowed then 'reply' else 'forward' end"


def metric_list() -> str:
    def has(t):
        return f"cast(sum(case when list_contains(types, {q(t)}) then 1 else 0 end) as bigint)"

    return f"""count(*) as n_messages, cast(sum(case when allowed then 1 else 0 end) as bigint) as n_allowed,
 cast(sum(case when allowed then 0 else 1 end) as bigint) as n_blocked, {has('token_limit')} as n_token_limit,
 {has('secrets')} as n_secrets, {has('pii')} as n_pii, {has('injection')} as n_injection,
 {has('toxicity')} as n_toxicity, cast(sum(case when pii_error is null then 0 else 1 end) as bigint) as n_failed,
 cast(sum(token_count) as bigint) as n_tokens"""


def listed(source_list: str, name: str, source: str = "whole") -> str:
    return f"""
select msg_id, cast(unnest(range(len(l))) as int) as seq, unnest(l) as {name}
from (select msg_id, {source_list} as l from {source})
"""


def secret_matches(n: int) -> str:
    return listed(found("txt", fv.SECRET_PATTERNS[n][1], 0, True), "matched")


def rule_rows(source: str) -> str:
    rows = " union all ".join(
        f"select msg_id, {q(r.name)} as rule, unnest(range(len(l))) as seq, unnest(l) as v from (select msg_id, {rule_values('message', r)} as l from {source})"
        for r in DEFAULT_RULES
    )
    return f"select msg_id, rule, cast(seq as int) as seq, v as value, {ENTROPY} as entropy from ({rows})"


SECRET_ROWS = " union all ".join(
    f"select msg_id, {n} as pattern_no, {q(t)} as type from whole where {hit('txt', p)}"
    for n, (t, p) in enumerate(fv.SECRET_PATTERNS)
)

_STATEMENTS: dict[str, str] = {
    "msg_source": "select msg_id, source, session_id, message from msgs",
    "reject_empty": f"""select msg_id, source, session_id, message, {q(fv.EMPTY_MESSAGE_REASON)} as reason
 from msgs where message is null or trim(message) = ''""",
    "token_count": "select msg_id, token_count from gated",
    "token_limit": f"""select msg_id, char_count, too_long, case when too_long then 'token_limit' end as violation,
 case when too_long then cast({fv.TOKEN_LIMIT_CONFIDENCE} as double) end as confidence,
 cast(length(scan_text) as int) as scanned_chars from gated""",
    "truncate_model_input": "select msg_id, model_text from gated",
    "length_label": f"select msg_id, {length_label('length(message)')} as length_label from msgs",
    "confidence_label": f"""
select msg_id, seq, confidence, {confidence_label('confidence')} as confidence_label from (
 select msg_id, cast(unnest(range(len(types))) as int) as seq, unnest({CONFIDENCES}) as confidence from wide)
""",
    "pii_email": listed(SUPPLEMENT[0][1], "value"),
    "pii_phone": listed(SUPPLEMENT[1][1], "value"),
    "pii_ssn": listed(SUPPLEMENT[2][1], "value"),
    "pii_card": listed(SUPPLEMENT[3][1], "value"),
    "pii_name_intro": listed(found("txt", fv.NAME_INTRO_PATTERN, 1, True), "value"),
    "pii_name_greeting": listed(found("txt", fv.NAME_GREETING_PATTERN, 1, True), "value"),
    "pii_values_by_type": """
select msg_id, cast(row_number() over (partition by msg_id order by type_no) - 1 as int) as type_seq, type,
 cast(len(vals) as int) as n_values, array_to_string(vals, '|') as joined_values from ip_vals where len(vals) > 0
""",
    "pii_spans": "select msg_id, s as span_start, e as span_end, type, score, v as value from every_spans",
    "pii_score_filter": f"""select msg_id, s as span_start, e as span_end, type, score from every_spans
 where score >= {fv.SPAN_SCORE_THRESHOLD}""",
    "pii_token_number": "select msg_id, s as span_start, e as span_end, t as type, token from every_num",
    "pii_redact_spans": "select msg_id, red as redacted from every_red",
    "pii_token_scan": "select msg_id, cast(ord as int) as seq, token from every_tok",
    "pii_token_bind": "select msg_id, type, value, token from every_ents where source = 'pii'",
    "pii_redact_fallback": "select msg_id, sanitized as sanitized_text from plain_out",
    "pii_entity_dedup": "select msg_id, seq, type, value, token, source from ip_ents",
    "pii_entities": "select msg_id, seq, type, value, token, source from plain_ents",
    "pii_gazetteer": """
select msg_id, cast(k.s as int) as span_start, cast(k.e as int) as span_end, k.type as type, k.value as value from (
 select msg_id, unnest(list_reduce(l, lambda a, x: case when x[1].s < a[-1].e then a else list_concat(a, x) end)) as k
 from (select msg_id, list([{'s': s, 'e': e, 'type': type, 'value': value}] order by s, e desc) as l from phrase_hits group by msg_id))
""",
    "restore": """select msg_id, red as reply, txt as restored from keyed_red""",
    "anonymize": f"""
select msg_id, sanitized as sanitized_text, n_entities, len(l) > 0 as secrets_detected, len(l) = 0 as secrets_valid,
 case when len(l) > 0 then cast(1 as double) else cast(0 as double) end as secrets_risk_score,
 array_to_string(l, ',') as secret_types
from ip_out join (select msg_id, {SECRET_LIST} as l from whole) using (msg_id)
""",
    "anonymize_strict": """
select msg_id, red as sanitized_text, cast(coalesce(n, 0) as int) as n_entities from every_red
left join (select msg_id, count(*) as n from every_num group by msg_id) using (msg_id)
""",
    "sec_api_key_assign": secret_matches(0),
    "sec_api_key_prefix": secret_matches(1),
    "sec_github": secret_matches(2),
    "sec_google": secret_matches(3),
    "sec_password": secret_matches(4),
    "sec_secret_assign": secret_matches(5),
    "sec_bearer": secret_matches(6),
    "sec_aws": secret_matches(7),
    "secret_findings": SECRET_ROWS,
    "secret_summary": f"""select source, type, count(*) as n_hits from ({SECRET_ROWS}) join msgs using (msg_id)
 group by source, type""",
    "secret_verdict": f"""
select msg_id, len(l) > 0 or r > 0 as detected, not (len(l) > 0 or r > 0) as is_valid,
 case when len(l) > 0 then greatest(r, cast(1 as double)) else r end as risk_score, array_to_string(l, ',') as secret_types
from (select msg_id, {SECRET_LIST} as l,
 case when {hit('txt', chr(92) + 'bref ' + chr(92) + 'd{7}' + chr(92) + 'b')} then cast(0.6 as double)
  else cast(0 as double) end as r from whole)
""",
    "secret_rules": rule_rows("(select msg_id, message from msgs union all select msg_id, message from credential_msgs)"),
    "scan_credentials": """select msg_id, r.allowed as allowed, u.allowed as allowed_without_rules
 from wide_credential r join wide_unruled u using (msg_id)""",
    "injection_score": f"select msg_id, {INJECTION} as injection_score from gated",
    "toxicity_ml": """select doc_id, cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 2)) as int) % 5 = 0 as held_out,
 true as in_range, true as tells_apart from documents""",
    "toxicity_lexicon": "select word, toxic_docs, clean_docs, weight from lexicon",
    "toxicity_score": """select g.msg_id, coalesce(score, cast(0 as double)) as toxicity_score
 from gated g left join tox t on t.msg_id = g.msg_id""",
    "threshold_apply": "select msg_id, injection_score, toxicity_score, has_injection, has_toxicity from wide_cut",
    "violations": f"""
select msg_id, cast(unnest(range(len(types))) as int) as seq, unnest(types) as type, unnest({CONFIDENCES}) as confidence,
 unnest({ACTIONS}) as action from wide
""",
    "primary_violation": "select msg_id, primary_type, primary_confidence from wide",
    "allowed": "select msg_id, allowed from wide",
    "anonymized_prompt": "select msg_id, has_pii, anonymized_prompt from wide",
    "tone_lookup": f"""
select msg_id, type, {lookup(fv.TONES, 'type', fv.DEFAULT_TONE)} as tone,
 {lookup(fv.INSTRUCTIONS, 'type', fv.DEFAULT_INSTRUCTION)} as instruction
from (select msg_id, unnest(list_prepend(source, types)) as type from wide)
""",
    "handoff": f"select msg_id, {HANDOFF.format('violation_type')} from wide",
    "detected_threats": f"""select msg_id, array_to_string(types, ',') as detected_threats,
 case when len(types) = 0 then {q(fv.RISK_SAFE)} end as risk_level from wide""",
    "scan_metrics": f"select {metric_list()} from wide",
    "session_rollup": f"select source, session_id, {metric_list()} from wide group by source, session_id",
    "metric_sketches": """
select source, count(*) as n_messages, cast(sum(case when allowed then 0 else 1 end) as bigint) as n_blocked,
 count(distinct message) as distinct_texts, count(distinct session_id) as distinct_sessions,
 true as texts_within, true as sessions_within, true as p50_within, true as p95_within
from wide group by source
""",
    "requeue": """
select msg_id, cast(0 as int) as attempts, allowed, anonymized_prompt from wide_plug where pii_error is null
union all
select b.msg_id, cast(1 as int), b.allowed, b.anonymized_prompt from wide_bare b join wide_plug p using (msg_id) where p.pii_error is not null
""",
    "session_risk": f"""
select msg_id, turn, turn_risk, max(turn_risk) over so_far as running_max, cast(sum(b) over so_far as bigint) as blocked_so_far,
 streak, streak >= 2 or sum(b) over so_far >= 3 as escalated from (
 select *, cast(case when b = 0 then 0 else row_number() over (partition by session_id, island order by turn, msg_id)
   - case when island > 0 then 1 else 0 end end as bigint) as streak from (
  select *, sum(1 - b) over (partition by session_id order by turn, msg_id rows unbounded preceding) as island from (
   select msg_id, session_id, cast(string_split(msg_id, '-')[-1] as int) as turn, case when allowed then 0 else 1 end as b,
    coalesce(list_max(list_transform(list_zip(types, {CONFIDENCES}), lambda x: case when x[1] = 'pii' then cast(0.5 as double) else cast(1 as double) end * x[2])), cast(0 as double)) as turn_risk
   from wide where source = 'conversations')))
window so_far as (partition by session_id order by turn, msg_id rows unbounded preceding)
""",
    "session_gaps": """
select session_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as n_messages,
 cast(sum(case when allowed then 0 else 1 end) as bigint) as n_blocked from (
 select *, sum(fresh) over (partition by session_id order by ts, msg_id rows unbounded preceding) as nr from (
  select *, case when ts - lag(ts) over (partition by session_id order by ts, msg_id) <= interval 6 hours then 0 else 1 end as fresh from wide_event))
group by session_id, nr
""",
    "threshold_curve": """
select cast(bin as double) / 100 as threshold, n, n_positive, cast(flagged as bigint) as flagged, cast(tp as bigint) as true_positives,
 round(tp / flagged, 9) as precision, round(tp / total, 9) as recall, round(2 * tp / (flagged + total), 9) as f1, round(calibrated, 9) as calibrated
from (select *, sum(n) over w as flagged, cast(sum(n_positive) over w as double) as tp, nullif(sum(n_positive) over (), 0) as total
 from curve_bins window w as (order by bin desc rows unbounded preceding)) join curve_pooled using (bin)
""",
    "violation_rollup": """
select source, type, cast(grouping_id(source, type) as bigint) as level, cast(count(*) as bigint) as n_violations
from (select source, unnest(types) as type from wide) group by rollup (source, type)
""",
    "scan": flat("wide", "msg_id, source, session_id"),
    "scan_response": flat("wide_bare", "msg_id"),
    "sink_roundtrip": flat("wide_bare", "msg_id"),
    "scan_dedup": flat("wide", "msg_id, source, session_id"),
    "scan_reuse": flat("wide", "msg_id, source, session_id"),
    "scan_with_model": """select msg_id, round(toxicity_score, 6) as toxicity_score, has_toxicity, allowed,
 array_to_string(types, ',') as violation_types from wide_bayes""",
    "scan_strict": flat("wide_strict", "msg_id"),
    "route_messages": f"""
select msg_id, {ROUTE} as route, case when not allowed then {PROMPT}
 else coalesce(nullif(anonymized_prompt, ''), message) end as outgoing_prompt from wide
""",
    "quarantine": f"""select msg_id, {ROUTE} as route, pii_error as reason, anonymized_prompt, allowed, array_to_string(types, ',') as violation_types
 from wide_plug where pii_error is not null""",
    "plugin_redaction": "select msg_id, allowed, anonymized_prompt, pii_error as pii_scanner_error from wide_plug",
    "stream_scan": flat("wide", f"msg_id, {ROUTE} as route"),
    "stream_reuse": flat("wide", f"msg_id, {ROUTE} as route"),
    "stream_scan_join": flat("wide", f"msg_id, {ROUTE} as route"),
}


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in PARTS:
        if name not in seen and re.search(rf"\b(?:from|join) {name}\b", sql):
            _needed(PARTS[name], seen)
            seen[name] = None
    return seen


def statements() -> dict[str, str]:
    """One stand-alone statement per query, led by the parts it uses."""
    out = {}
    for name, sql in _STATEMENTS.items():
        parts = ", ".join(f"{p} as ({PARTS[p]})" for p in _needed(sql, {}))
        out[name] = f"with {parts} {sql}" if parts else sql
    return out
