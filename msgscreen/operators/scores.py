"""Injection and toxicity scores in [0, 1], and the thresholds over them.

No published rules or weights exist for these scanners, so the rules are our
own and the toxicity lexicon is learned from labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.patterns import matches
from ..functions.text import words
from ..functions.wordset import ChecksumFilter
from .dedup import text_key


def injection_score(text: str, rules=fv.INJECTION_RULES) -> Column:
    """Weight of the heaviest rule that occurs, 0 when none does.

    Rules are tried from heavy to light and the first hit ends the row.
    """
    ordered = sorted(rules, key=lambda r: -r[2])
    cases = " ".join(f"when {matches(text, p, ignore_case=True)} then {float(w)}D" for _, p, w in ordered)
    return F.expr(f"case {cases} else 0D end" if cases else "0D")


def learn_lexicon(
    documents: DataFrame,
    labels: DataFrame,
    min_support: int = 5,
    min_weight: float = 0.8,
) -> DataFrame:
    """Words that mark toxic documents: ``word, toxic_docs, clean_docs, weight``.

    Words are counted once per document over the whole text, so the grouped
    count combines on the map side and a word found in every document costs one
    partial row per task. ``weight`` is the lower bound, one deviation down
    (Wilson), of the toxic share of the word after balancing the two classes: it
    grows with the evidence, and a threshold tells strong marks from weak ones.
    Words are chosen by evidence alone, however many there are.
    """
    # The labels may be as many as the documents, so they are never broadcast. Distinct
    # words travel in place of texts, joined, as an array takes twice the room.
    held = documents.select("doc_id", F.array_join(F.array_distinct(words(F.col("text"))), " ").alias("held")).where("held <> ''")
    labelled = held.join(labels.select("doc_id", "toxic").hint("merge"), "doc_id")
    seen = labelled.select((F.col("toxic") == 1).cast("long").alias("t"), F.explode(F.split("held", " ")).alias("word"))
    counts = seen.groupBy("word").agg(F.sum("t").alias("toxic_docs"), F.sum(1 - F.col("t")).alias("clean_docs"))
    totals = labels.agg(
        F.sum(F.col("toxic").cast("long")).alias("n_toxic"),
        F.sum((1 - F.col("toxic")).cast("long")).alias("n_clean"),
    )
    n_toxic = totals.select("n_toxic").scalar()
    n_clean = totals.select("n_clean").scalar()
    balance = n_toxic.cast("double") / F.greatest(n_clean, F.lit(1)).cast("double")
    seen_docs = counts.withColumn("n", F.col("toxic_docs") + F.col("clean_docs") * balance)
    shares = seen_docs.withColumn("share", F.col("toxic_docs") / F.col("n"))
    bound = "share * (n / (n + 1)) + 0.5D / (n + 1) - sqrt(share * (1 - share) * n + 0.25D) / (n + 1)"
    return (
        shares.where(F.col("toxic_docs") >= min_support)
        .withColumn("weight", F.expr(bound))
        .where(F.col("weight") >= min_weight)
        .select("word", "toxic_docs", "clean_docs", "weight")
    )


# A lexicon up to this size may stand in the plan and be looked up in each row; a larger one is joined.
IN_ROW_WORDS = 4096
IN_ROW_WORD_CHARS = 200


@dataclass(frozen=True)
class SmallLexicon:
    """A lexicon of checked size as literals of the plan.

    A filter tells in constant time that nearly all other words are not in it; only the
    words that pass are looked for in the list.
    """

    words: tuple[str, ...]
    weights: tuple[float, ...]

    @classmethod
    def of(cls, lexicon: DataFrame) -> SmallLexicon | None:
        """The lexicon if it is small enough; reads one row more than that at most."""
        known = lexicon.where("word is not null and weight is not null").select("word", F.col("weight").cast("double"))
        rows = known.limit(IN_ROW_WORDS + 1).collect()
        # Nothing but runs of letters is ever looked up.
        if len(rows) > IN_ROW_WORDS or any(len(r.word) > IN_ROW_WORD_CHARS or " " in r.word for r in rows):
            return None
        best: dict[str, float] = {}
        for r in rows:
            best[r.word] = max(r.weight, best.get(r.word, r.weight))
        return cls(tuple(best), tuple(best.values()))

    def heaviest(self, found: Column) -> Column:
        """The largest weight of the words of an array, 0 when none is known."""
        if not self.words:
            return F.lit(0.0)
        # Both lists fold to literals when the plan is optimised.
        words = F.split(F.lit(" ".join(self.words)), " ")
        weights = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")

        may_be = ChecksumFilter.of_words(self.words).may_hold
        weight = lambda word: F.get(weights, (F.array_position(words, word) - 1).cast("int"))
        return F.coalesce(F.array_max(F.transform(F.filter(found, may_be), weight)), F.lit(0.0))


def with_toxicity_score(
    df: DataFrame, text: str, lexicon: DataFrame | None, out: str = "toxicity_score", in_row: bool | None = None
) -> DataFrame:
    """Add the weight of the heaviest lexicon word in the text, 0 when there is none.

    The lexicon should be a stored table: its size is checked when the plan is made.
    Up to ``IN_ROW_WORDS`` words it is looked up inside each row, and no row is
    shuffled. Beyond that, words meet the lexicon in a join; only hits go on, one
    weight per distinct text after combining, and meet the rows by a hash of the
    text. Rows without a text (over-long messages) can't score and take no part in it.
    ``in_row`` False asks for the join at any size; True refuses a larger lexicon.
    """
    if lexicon is None:
        return df.withColumn(out, F.lit(0.0))
    if in_row is not False:
        small = SmallLexicon.of(lexicon)
        if small is not None:
            return df.withColumn(out, small.heaviest(words(F.col(text))))
        if in_row:
            raise ValueError(f"the lexicon has more than {IN_ROW_WORDS} words, too many for each row")
    if df.isStreaming:
        raise ValueError("a stream can't be joined with its own words: start it with per_batch, or use a small lexicon")
    scored_rows = df.where(F.col(text).isNotNull())
    keyed = scored_rows.withColumn("_text_key", text_key(F.col(text)))
    may_be = ChecksumFilter.of_column(lexicon, "word").may_hold
    found = keyed.select("_text_key", F.explode(F.array_distinct(F.filter(words(F.col(text)), may_be))).alias("word"))
    best = found.join(lexicon.select("word", "weight"), "word").groupBy("_text_key").agg(F.max("weight").alias("_best"))
    scored = keyed.join(best, "_text_key", "left").withColumn(out, F.coalesce(F.col("_best").cast("double"), F.lit(0.0)))
    unscored = df.where(F.col(text).isNull()).withColumn(out, F.lit(0.0))
    return scored.select(*df.columns, out).unionByName(unscored)


def over_threshold(score: str, threshold: float) -> Column:
    """Thresholds are inclusive; no score is no detection."""
    return F.expr(f"coalesce({score} >= {float(threshold)}D, false)")
