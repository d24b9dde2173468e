"""Boundaries to models: scorers, rewriters and generators that are loaded once in each Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_stream, scalar
from tessera.functions.features import score as rule_score
from tessera.functions.pytext import strip

#: A loader gives a function from a list of texts to one result each.
Loader = Callable[[], Callable[[list[str]], list]]


def label_score(label: str, score: float) -> float:
    """The class number of a numbered label, else five times the score."""
    m = re.fullmatch(r"LABEL_(\d+)", label)
    return float(m[1]) if m else 5.0 * score


def scored_by(df: DataFrame, key: str, text: str, load: Loader, most_chars: int = 2048) -> DataFrame:
    """(key, score): a model's score from 0 to 5 of the first ``most_chars`` characters, what its classifier reads at most.

    Null texts score 0; a batch in which the model fails has null scores.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        model = None
        for keys, texts in batches:
            try:
                model = model or load()
                scores = [min(5.0, max(0.0, float(s))) for s in model([t or "" for t in texts])]
            except Exception:  # noqa: BLE001 - a model may fail in any way
                scores = [None] * len(keys)
            yield [(k, 0.0 if t is None else s) for k, t, s in zip(keys, texts, scores)]

    return map_stream(df.select(key, F.substring(text, 1, most_chars).alias(text)), run, f"{key} {kind}, score double")


def generated(df: DataFrame, key: str, prompt: str, load: Loader, n: int = 1) -> DataFrame:
    """(key, sample_no, text): ``n`` texts for each prompt; a prompt for which the model fails gets empty texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        model = None
        for keys, prompts in batches:
            out = []
            for k, p in zip(keys, prompts):
                try:
                    model = model or load()
                    texts = [str(model([p or ""])[0]) for _ in range(n)]
                except Exception:  # noqa: BLE001 - a service may fail in any way
                    texts = [""] * n
                out += [(k, i, t) for i, t in enumerate(texts)]
            yield out

    return map_stream(df.select(key, prompt), run, f"{key} {kind}, sample_no int, text string")


#: A scorer gives the score of a text from the text and its features.
Scorer = Callable[[Column, Column], Column]
#: A rewriter gives (text, decision, error) of a text; a null error means success.
Rewriter = Callable[[Column], tuple[Column, Column, Column]]


def _remembered(load: Loader) -> Callable[[], Callable[[list[str]], list]]:
    """The model of a loader, loaded at the first use in each Python worker."""
    held: list = []

    def model() -> Callable[[list[str]], list]:
        if not held:
            held.append(load())
        return held[0]

    return model


def model_scorer(load: Loader, most_chars: int = 2048) -> Scorer:
    """A scorer for the cleaner out of a model: batches of texts, cut to what its classifier reads at most.

    Null texts score 0. A batch in which the model fails is scored by the rules.
    """
    model = _remembered(load)

    def told(texts: pd.Series) -> pd.Series:
        given = [t or "" for t in texts]
        try:
            return pd.Series([min(5.0, max(0.0, float(x))) if t else 0.0 for t, x in zip(given, model()(given))], dtype="float64")
        except Exception:  # noqa: BLE001 - a model may fail in any way
            return pd.Series([None] * len(given), dtype="float64")

    asked = F.pandas_udf(told, "double").asNondeterministic()  # asked once for each text, not again for each use of the score

    return lambda text, features: F.coalesce(F.nanvl(asked(F.substring(text, 1, most_chars)), F.lit(None).cast("double")), rule_score(features))


def parsed_reply(reply: Column) -> tuple[Column, Column]:
    """Decision and text of a reply with ``DECISION:`` and ``TEXT:`` parts; an unknown decision keeps, a reply without parts is the text."""
    said = F.lower(F.regexp_extract(reply, r"DECISION:\s*(\w+)", 1))
    text = F.when(reply.rlike(r"TEXT:\s*\n"), F.regexp_extract(reply, r"(?s)TEXT:\s*\n(.*)", 1)).otherwise(reply)
    return F.when(said.isin("keep_as_is", "light_clean", "rewrite", "drop"), said).otherwise("keep_as_is"), strip(text)


def model_rewriter(load: Loader) -> Rewriter:
    """A rewriter for the cleaner out of a model that replies to a text; a failure is the text's error."""
    model = _remembered(load)

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return str(model()([text or ""])[0]), None
        except Exception as e:  # noqa: BLE001 - a service may fail in any way
            return None, str(e) or type(e).__name__

    asked = scalar(one, "struct<reply: string, error: string>", once=True)

    def rewriter(text: Column) -> tuple[Column, Column, Column]:
        said = asked(text)
        decision, new = parsed_reply(said["reply"])
        failed = said["error"].isNotNull()
        return F.when(failed, text).otherwise(new), F.when(failed, "keep_as_is").otherwise(decision), said["error"]

    return rewriter


def rounds_done(pairs: int, target: int, share: float = 0.9) -> bool:
    """Whether further rounds are needed no more: enough pairs are there."""
    return pairs >= share * target
