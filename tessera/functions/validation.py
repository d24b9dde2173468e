"""Checks that a rewritten text kept the mathematics of the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.features import NUMBER, SYMBOL, Rules, feature_struct, score
from tessera.functions.pytext import count, let


def _recall(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def variables(t: Column) -> Column:
    """Single letters with their subscripts, but for the article."""
    pattern = r"(?U)\b([a-zA-Z])(?:_\{?([a-zA-Z0-9]+)\}?)?\b"
    names, subs = F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    pairs = F.filter(F.arrays_zip(names.alias("n"), subs.alias("s")), lambda x: F.lower(x["n"]) != "a")
    return F.array_distinct(F.transform(pairs, lambda x: F.when(x["s"] != "", F.concat(x["n"], F.lit("_"), x["s"])).otherwise(x["n"])))


def number_recall(a: Column, b: Column) -> Column:
    return _recall(F.regexp_extract_all(a, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(b, F.lit(NUMBER), F.lit(0)))


def variable_recall(a: Column, b: Column) -> Column:
    return _recall(variables(a), variables(b))


def symbol_recall(a: Column, b: Column) -> Column:
    n = count(a, SYMBOL)
    return F.when(n == 0, 1.0).otherwise(F.least(F.try_divide(count(b, SYMBOL), n), F.lit(1.5)))


def brackets_kept(a: Column, b: Column) -> Column:
    """No kind of bracket is out of balance by more than two more than before."""
    ok = F.lit(True)
    for left, right in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}")):
        ok = ok & (F.abs(count(b, left) - count(b, right)) <= F.abs(count(a, left) - count(a, right)) + 2)
    return ok


def latex_kept(a: Column, b: Column) -> Column:
    """Dollar signs stay paired, and begin and end of environments differ by at most one more."""
    off = lambda t: F.abs(count(t, r"\\begin\{") - count(t, r"\\end\{"))
    return ~((count(a, r"\$") % 2 == 0) & (count(b, r"\$") % 2 != 0)) & (off(b) <= off(a) + 1)


def validate(a: Column, b: Column, score_raw: Column, r: Rules = Rules(), post: Column | None = None) -> Column:
    """A struct of the checks of text ``b`` against ``a``, with the reasons of failure in order.

    ``post`` is the score of ``b``; without it the rules score it.
    """
    return let(measures(a, b, post), lambda m: verdict(m, score_raw, r))


def measures(a: Column, b: Column, post: Column | None = None) -> Column:
    post = let(feature_struct(b), score) if post is None else post
    ratio = F.when(F.length(a) == 0, 1.0).otherwise(F.try_divide(F.length(b), F.length(a)))
    return F.struct(
        number_recall(a, b).alias("number"), variable_recall(a, b).alias("variable"), symbol_recall(a, b).alias("symbol"), brackets_kept(a, b).alias("brackets"), latex_kept(a, b).alias("latex"), ratio.alias("ratio"), post.alias("post"),
    )


def verdict(m: Column, score_raw: Column, r: Rules) -> Column:
    number, variable, symbol, brackets, latex, ratio, post = (m[n] for n in ("number", "variable", "symbol", "brackets", "latex", "ratio", "post"))
    lost = score_raw - post
    reasons = F.array_compact(
        F.array(
            F.when(number < r.number_recall_min, F.format_string(f"number_recall=%.2f<{r.number_recall_min}", number)),
            F.when(variable < r.variable_recall_min, F.format_string(f"variable_recall=%.2f<{r.variable_recall_min}", variable)),
            F.when(symbol < r.symbol_recall_min, F.format_string(f"symbol_recall=%.2f<{r.symbol_recall_min}", symbol)),
            F.when(~brackets, F.lit("bracket_balance_worsened")),
            F.when(~latex, F.lit("latex_balance_worsened")),
            F.when(ratio < r.length_ratio_min, F.format_string(f"length_ratio=%.2f<{r.length_ratio_min}", ratio)),
            F.when(ratio > r.length_ratio_max, F.format_string(f"length_ratio=%.2f>{r.length_ratio_max}", ratio)),
            F.when((lost > r.max_clean_score_drop) & (post < r.min_post_score_absolute), F.format_string(f"score_dropped: %.2f->%.2f (drop=%.2f>{r.max_clean_score_drop})", score_raw, post, lost)),
        )
    )
    return F.struct(
        (F.size(reasons) == 0).alias("validation_pass"), F.round(number, 4).alias("number_recall"), F.round(variable, 4).alias("variable_recall"), F.round(symbol, 4).alias("symbol_recall"), F.round(ratio, 4).alias("length_ratio"),
        brackets.alias("bracket_balance_ok"), latex.alias("latex_balance_ok"), F.round(score_raw, 4).alias("score_raw"), F.round(post, 4).alias("score_post"), reasons.alias("fail_reasons"),
    )
