"""Slots for models of the caller: Python scorers and span recognisers.

The only Python in the package. A plug-in sees Arrow batches of one text column and
loads its model once per worker process. A loader marked with ``takes_batches`` gives
a model that is called with a list of texts and answers with a list of results;
should that call raise, or answer with another number of results, the texts of the
batch are tried one by one, so that only rows that fail by themselves do. Other
loaders give a model of a single text. An exception becomes ``error`` text beside a
null result instead of failing the task or letting an unscanned row pass. Helpers
are closures, so workers need no copy of the package.

Plug-ins are marked as not deterministic. A filter on a result, such as the one
for failed rows, would else be pushed below the projection and run the model a
second time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPAN_FIELDS

SCORE_RESULT = "struct<score:double,error:string>"
SPAN_RESULT = f"struct<spans:array<{SPAN_FIELDS}>,error:string>"


def takes_batches(load: Callable[[], Callable[[list[str]], list]]) -> Callable:
    """Mark a loader whose model takes a list of texts and gives a list of results."""
    load.takes_batches = True
    return load


def _plug_in(load: Callable[[], Callable], check: Callable[[Any, str], Any], columns: list[str], dtypes: dict[str, str], result: str):
    """A pandas UDF over one text column; ``check(result, text)`` gives the value of a row or raises."""
    batched = getattr(load, "takes_batches", False)
    try:
        key = vars(load).setdefault("model_key", uuid.uuid4().hex)
    except TypeError:  # a callable without attributes
        key = uuid.uuid4().hex

    def loaded():
        """The model of this worker process; tasks that follow find it where the first one left it."""
        import sys

        models = vars(sys).setdefault("_plug_in_models", {})
        if key not in models:
            models[key] = load()
        return models[key]

    def attempt(model, text: str) -> tuple:
        try:
            return check(model([text])[0] if batched else model(text), text), None
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def answers(model, texts: list[str]) -> list[tuple]:
        if batched and texts:
            try:
                found = list(model(texts))
                if len(found) == len(texts):
                    return [(check(x, t), None) for x, t in zip(found, texts)]
            except Exception:
                pass  # the rows are tried alone, and those that fail say why
        return [attempt(model, t) for t in texts]

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded()
        for texts in batches:
            known = [i for i, t in enumerate(texts) if t is not None]
            rows: list[tuple] = [(None, None)] * len(texts)
            for i, answer in zip(known, answers(model, [texts.iloc[i] for i in known])):
                rows[i] = answer
            yield pd.DataFrame(rows, columns=columns).astype(dtypes)

    return run.asNondeterministic()


def model_score(text: Column, load: Callable[[], Callable]) -> Column:
    """``struct<score,error>`` of a scorer; ``load()`` gives ``text -> score`` or, marked, ``texts -> scores``."""

    def check(found, text):
        score = float(found)
        if not 0.0 <= score <= 1.0:
            raise ValueError(f"score {score} is not in [0, 1]")
        return score

    return _plug_in(load, check, ["score", "error"], {"score": "float64", "error": "object"}, SCORE_RESULT)(text)


def model_spans(text: Column, load: Callable[[], Callable]) -> Column:
    """``struct<spans,error>`` of a recogniser; ``load()`` gives ``text -> [(type, start, end, score)]`` or, marked, one such list a text."""

    def check(found, text):
        found = list(found)
        for kind, start, end, score in found:
            if not 0 <= start < end <= len(text) or not 0.0 <= float(score) <= 1.0:
                raise ValueError(f"span {kind} {start}-{end} with score {score} does not fit the text")
        return [
            {"start": start, "end": end, "type": kind, "score": float(score), "value": text[start:end]}
            for kind, start, end, score in found
        ]

    return _plug_in(load, check, ["spans", "error"], {"spans": "object", "error": "object"}, SPAN_RESULT)(text)
