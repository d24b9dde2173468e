"""The corpus cleaner: segments cleaned by rules, scored, routed, rewritten, validated and audited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cleaning import BOILERPLATE_LINE, cut_tails, drop_lines, squeeze, with_clean_text
from tessera.functions.features import Rules, drop_after_cleaning, feature_struct, hard_drop, needs_rewrite, route, score, strong_math
from tessera.functions.pytext import let, once, strip
from tessera.functions.validation import validate
from tessera.operators.models import Rewriter, Scorer, model_rewriter, model_scorer
from tessera.operators.segment import segment_documents

def keep_as_is(text: Column) -> tuple[Column, Column, Column]:
    return text, F.lit("keep_as_is"), F.lit(None).cast("string")


def drop_repeated_sentences(c: Column) -> Column:
    """Without sentences equal to the one before, joined by spaces; a text of one sentence stays as it is."""

    def kept(parts: Column) -> Column:
        return F.array_join(F.filter(parts, lambda x, i: (i == 0) | (strip(x) != strip(F.element_at(parts, F.greatest(i, F.lit(1)))))), " ")

    return let(F.split(c, r"(?U)(?<=[.。!！?？])\s+", -1), kept)


def rule_rewriter(text: Column) -> tuple[Column, Column, Column]:
    """The rewriter without a model: tails, boilerplate lines, repeated sentences and white space."""
    out = strip(squeeze(drop_repeated_sentences(drop_lines(cut_tails(text), BOILERPLATE_LINE))))
    changed = lambda o: (F.abs(F.length(o) - F.length(text)) > 10) | (o != strip(text))
    return out, let(out, lambda o: F.when(changed(o), "light_clean").otherwise("keep_as_is")), F.lit(None).cast("string")


#: Rewriters by kind; ``model`` takes a loader.
REWRITERS: dict[str, Callable[..., Rewriter]] = {"noop": lambda: keep_as_is, "regex": lambda: rule_rewriter, "model": model_rewriter}
#: Scorers by kind; ``model`` takes a loader.
SCORERS: dict[str, Callable[..., Scorer]] = {"rules": lambda: rule_scorer, "model": model_scorer}


def rule_scorer(text: Column, features: Column) -> Column:
    """The score without a model, by the features alone."""
    return score(features)


def rewriter(kind: str, *args) -> Rewriter:  # noqa: ANN002
    """The rewriter of a kind of REWRITERS."""
    if kind not in REWRITERS:
        raise ValueError(f"unknown rewriter {kind!r}")
    return REWRITERS[kind](*args)


def scorer(kind: str, *args) -> Scorer:  # noqa: ANN002
    """The scorer of a kind of SCORERS."""
    if kind not in SCORERS:
        raise ValueError(f"unknown scorer {kind!r}")
    return SCORERS[kind](*args)


def ruled(segments: DataFrame, r: Rules = Rules(), rate: Scorer = rule_scorer) -> DataFrame:
    """Segments with cleaned text, raw and cleaned features, drop flag, signals, score and route."""
    df = with_clean_text(segments.withColumn("raw", once(feature_struct("text"))), "text", "cleaned")
    df = df.withColumn("cleaned", once(F.col("cleaned"))).withColumn("features", once(feature_struct("cleaned")))
    raw, f = F.col("raw"), F.col("features")
    df = df.withColumn("hard_drop", hard_drop(raw, r) | drop_after_cleaning(raw, F.col("cleaned"), r)).withColumn("strong_math_signal", strong_math(f)).withColumn("needs_llm_cleanup", needs_rewrite(f))
    return df.withColumn("score", once(rate(F.col("cleaned"), f))).withColumn("step", F.when(F.col("hard_drop") | (strip("cleaned") == ""), "hard_drop").otherwise(route(F.col("score"), f, r)))


def decided(df: DataFrame, rewrite: Rewriter = rule_rewriter, r: Rules = Rules(), rate: Scorer = rule_scorer) -> DataFrame:
    """``ruled`` segments with the audit's columns and the kept text and quality score, null where dropped."""
    text, said, error = rewrite(F.col("cleaned"))
    df = df.withColumns({"new_text": once(F.when(F.col("step") == "llm", text)), "said": F.when(F.col("step") == "llm", said), "error": F.when(F.col("step") == "llm", error)})
    post = None
    if rate is not rule_scorer:  # a model's score is a column of its own, as no function in Python may stand within an expression of the checks
        df = df.withColumn("_post", once(rate(F.col("new_text"), feature_struct("new_text"))))
        post = F.col("_post")
    df = df.withColumn("v", once(F.when((F.col("step") == "llm") & F.col("error").isNull() & (F.col("said") != "drop"), validate(F.col("cleaned"), F.col("new_text"), F.col("score"), r, post))))
    passed, v = F.coalesce(F.col("v.validation_pass"), F.lit(False)), F.col("v")
    step, fallback = F.col("step"), F.col("score") >= r.fallback_min_raw_score
    failed = (step == "llm") & (F.col("error").isNotNull() | (v.isNotNull() & ~passed))
    final = F.when(step == "keep", "kept_light_cleaned").when(passed, "kept_llm_processed").when(failed & fallback, "fallback_to_light_cleaned").otherwise("dropped")
    reasons = (
        F.when(step == "hard_drop", F.array(F.lit("hard_drop_by_rule"))).when(step == "drop", F.array(F.lit("low_score_weak_math"))).when(F.col("error").isNotNull(), F.array(F.concat(F.lit("llm_error: "), F.col("error"))))
        .when((step == "llm") & (F.col("said") == "drop"), F.array(F.lit("llm_decided_drop"))).when(v.isNotNull() & ~passed, F.col("v.fail_reasons")).otherwise(F.array().cast("array<string>"))
    )
    df = df.withColumn("route", once(final))
    final = F.col("route")
    return df.withColumns(
        {
            "classifier_score_raw": F.when(step != "hard_drop", F.col("score")),
            "classifier_score_post": F.col("v.score_post"),
            "llm_decision": F.when(F.col("error").isNotNull(), "error").otherwise(F.col("said")),
            "validation_pass": F.col("v.validation_pass"),
            "fail_reasons": reasons,
            "kept_text": F.when(final == "kept_llm_processed", F.col("new_text")).when(final != "dropped", F.col("cleaned")),
            "quality_score": F.when(final == "kept_llm_processed", F.col("v.score_post")).when(final != "dropped", F.round("score", 4)),
        }
    ).drop("_post")


def clean_documents(docs: DataFrame, rewrite: Rewriter = rule_rewriter, r: Rules = Rules(), rate: Scorer = rule_scorer) -> DataFrame:
    """All segments of documents (id, text) with their decisions. One pass; write audit and output from it.

    ``rate`` scores segments before and after rewriting, ``rewrite`` takes those between keeping and dropping.
    """
    return decided(ruled(segment_documents(docs, r), r, rate), rewrite, r, rate)


def audit(df: DataFrame) -> DataFrame:
    return df.select(F.col("segment_id").alias("id"), "route", "classifier_score_raw", "classifier_score_post", "llm_decision", "validation_pass", "fail_reasons")


def output(df: DataFrame) -> DataFrame:
    """The kept segments. A generator keeps the rows, as a filter's constraints would be traced through every rule."""
    kept = F.struct(F.col("segment_id").alias("id"), F.col("kept_text").alias("text"), "quality_score")
    return df.select(F.inline(F.when(F.col("route") != "dropped", F.array(kept)).otherwise(F.array().cast("array<struct<id: string, text: string, quality_score: double>>"))))


def summary(audited: DataFrame) -> DataFrame:
    """Counters of one run over audit rows (id, route, llm_decision, fail_reasons)."""
    dropped = F.col("route") == "dropped"
    by_rule = dropped & (F.col("llm_decision").isNull() | F.exists("fail_reasons", lambda x: x.startswith("hard_drop")))
    n = lambda c: F.count_if(c)
    return audited.agg(
        F.count_distinct(F.regexp_replace("id", r"(?s)_seg_(?!.*_seg_).*$", "")).alias("total_documents"), F.count("*").alias("total_segments"), n(by_rule).alias("rule_dropped"), n(F.col("route") == "kept_light_cleaned").alias("direct_kept"),
        n(F.col("llm_decision").isNotNull()).alias("sent_to_llm"), n(F.col("route") == "kept_llm_processed").alias("llm_passed_validation"), n(F.col("route") == "fallback_to_light_cleaned").alias("llm_failed_fallback"), n(~dropped).alias("final_kept"), n(dropped).alias("final_dropped"),
    )


def resume(docs: DataFrame, audited: DataFrame) -> DataFrame:
    """Documents (id, ...) of which no segment has an audit row (id) yet: dropped documents count as done."""
    done = audited.select(F.regexp_replace("id", r"(?s)_seg_(?!.*_seg_).*$", "").alias("id")).distinct()
    return docs.join(done, docs["id"].cast("string") == done["id"], "left_anti")
