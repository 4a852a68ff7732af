"""Phrases of a dictionary of any size, found in texts with exact offsets, the longest first.

Texts are cut into words once. Every run of words that only blanks separate, up to the
length of the longest phrase, is looked up by its lower-cased words: first in a filter
of fixed size inside the row, which lets nearly nothing through that isn't a phrase, then
in the dictionary by a join. Of overlapping phrases the one that starts first stays, of
those the longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import quoted
from ..functions.wordset import ChecksumFilter
from ..sources.storage import shared_dir

WORD = r"[\p{L}\p{N}]+"
BLANK = r"^\s+$"
HIT = "struct<i:int,less:int,type:string>"


def phrase_words(text: str) -> str:
    """The lower-cased words of a phrase, joined by one blank: how phrases and runs of words are compared."""
    return f"array_join(transform(regexp_extract_all({text}, {quoted(WORD)}, 0), w -> lower(w)), ' ')"


def dictionary(phrases: DataFrame, phrase: str = "phrase", type_: str = "type") -> DataFrame:
    """``words, type, n``: distinct phrases by their words; of several types the first by name. Blank ones drop out."""
    cut = phrases.select(F.expr(f"{phrase_words(phrase)} as words"), F.col(type_).alias("type"))
    found = cut.where("length(words) > 0").groupBy("words").agg(F.min("type").alias("type"))
    return found.withColumn("n", F.expr("size(split(words, ' '))"))


def all_words(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(WORD)}, 0)"


def all_gaps(text: str) -> str:
    return f"split({text}, {quoted(WORD)}, -1)"


def first_and_longest(hits: str) -> str:
    """Of overlapping hits the first, of those the longest."""
    return f"""aggregate(sort_array({hits}), named_struct('free', 0, 'out', cast(array() as array<{HIT}>)),
      (s, x) -> case when x.i < s.free then s else named_struct('free', x.i - x.less, 'out', concat(s.out, array(x))) end, s -> s.out)"""


def find_phrases(df: DataFrame, known: DataFrame, key: str = "msg_id", text: str = "message") -> DataFrame:
    """``key, start, end, type, value`` of every phrase found; offsets in code points, end exclusive.

    ``known`` is a stored ``dictionary``: the length of its longest phrase and a filter
    over its checksums are read when the plan is made. Only runs that pass the filter
    leave their row, as places and words, and the dictionary has one row for each on the
    other side, so a phrase in a third of all texts can be split. ``key`` is unique; null
    texts have no phrase. Hits of one text meet in one row again; settling them costs
    about the square of their number, measuring their places the length of the text.
    """
    longest = known.agg(F.max("n")).first()[0] or 0
    may_hold = ChecksumFilter.of_column(known, "words").may_hold
    texts = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    cut = texts.withColumns({"_words": F.expr(all_words("_text")), "_gaps": F.expr(all_gaps("_text"))})
    # The gap before word i is _gaps[i]; a run goes on where that is blank.
    ready = cut.where("size(_words) > 0").select(
        key, F.expr("transform(_words, w -> lower(w)) as _low"), F.expr(f"transform(_gaps, g -> rlike(g, {quoted(BLANK)})) as _tied")
    )
    runs = [
        f"""filter(transform(sequence(0, size(_low) - 1), i -> case when i + {n} <= size(_low) and forall(slice(_tied, i + 2, {n - 1}), t -> t)
              then named_struct('words', array_join(slice(_low, i + 1, {n}), ' '), 'i', i, 'n', {n}) end), r -> r is not null)"""
        for n in range(1, longest + 1)
    ]
    passed = [F.filter(F.expr(r), lambda x: may_hold(x["words"])) for r in runs] or [F.expr("cast(array() as array<struct<words:string,i:int,n:int>>)")]
    candidates = ready.select(key, F.explode(F.concat(*passed)).alias("r")).select(key, "r.*")
    hits = candidates.join(known.select("words", "type"), "words").select(key, F.struct("i", (-F.col("n")).alias("less"), "type").alias("h"))
    by_text = hits.groupBy(key).agg(F.collect_list("h").alias("hits")).select(key, F.expr(first_and_longest("hits")).alias("hits"))
    # Places in code points: between two hits only the words and gaps that lie there are measured.
    # Hits are few beside texts: stored, their size lets the join leave the texts where they are. Texts are cut after it.
    path = shared_dir(df.sparkSession, "phrase-hits")
    by_text.write.parquet(path)
    found = texts.join(df.sparkSession.read.schema(by_text.schema).parquet(path), key)
    found = found.withColumns({"_words": F.expr(all_words("_text")), "_gaps": F.expr(all_gaps("_text"))})
    passed_by = lambda frm, to: f"length(array_join(slice(_words, {frm} + 1, {to} - {frm}), '')) + length(array_join(slice(_gaps, {frm} + 1, {to} - {frm}), ''))"
    spans = f"""aggregate(hits, named_struct('word', 0, 'at', 0, 'out', cast(array() as array<struct<start:int,end:int,type:string>>)),
      (s, x) -> named_struct('word', x.i, 'at', s.at + {passed_by('s.word', 'x.i')}, 'out', concat(s.out, array(named_struct(
        'start', s.at + {passed_by('s.word', 'x.i')} + length(_gaps[x.i]),
        'end', s.at + {passed_by('s.word', 'x.i')} + {passed_by('x.i', '(x.i - x.less)')}, 'type', x.type)))),
      s -> s.out)"""
    rows = found.select(key, "_text", F.explode(F.expr(spans)).alias("s"))
    return rows.select(key, "s.start", "s.end", "s.type", F.expr("substring(_text, s.start + 1, s.end - s.start)").alias("value"))
