"""Rule features of a text segment, its heuristic score and its route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.cleaning import BOILERPLATE_LINE, LINK
from tessera.functions.pytext import col, count, found, stripped_lines

# What counts as symbol, command, number, variable, keyword and signal.
SYMBOL = r"[+\-*/=≠≤≥≈∞∑∏∫∂∇±×÷∈∉⊂⊃∪∩∧∨¬⇒⇔∀∃]"
COMMANDS = "frac|int|sum|prod|lim|sqrt|partial|nabla|infty|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|pi|phi|psi|begin|end|left|right|text|mathbb|mathcal|mathbf|mathrm|operatorname"
NUMBER = r"-?\d+(?:\.\d+)?(?:/\d+)?%?"
VARIABLE = r"(?U)\b([a-zA-Z])(?:_\{?[a-zA-Z0-9]+\}?)?\b"
KEYWORDS = "theorem|lemma|proposition|corollary|definition|proof|example|solution|exercise|problem|equation|formula|integral|derivative|function|matrix|vector|polynomial|inequality|sequence|convergence|limit|continuous|differentiable"
KEYWORDS_ZH = "定理|引理|命题|推论|定义|证明|例题|解题|练习|题目|方程|公式|积分|导数|函数"
PROBLEM = r"(?:problem|exercise|question|example)\s*[\d.:)]|(?:solution|answer|proof)\s*[:.]|题目|解[：:]|解答|证明[：:]"
PROOF = r"(?:proof|prove|Q\.E\.D\.|∎|□)|证明|证毕"

FEATURES = ("char_len", "link_ratio", "repeat_ratio", "boilerplate_hits", "symbol_count", "latex_cmd_count", "number_count", "variable_like_count", "math_keyword_count", "has_problem_solution_signal", "has_proof_signal")


@dataclass(frozen=True)
class Rules:
    """Thresholds of segmentation, routing, validation and fallback."""

    min_segment_chars: int = 40
    ideal_min_chars: int = 200
    ideal_max_chars: int = 1500
    hard_max_chars: int = 2200
    clf_keep: float = 4.2
    clf_keep_with_math: float = 3.8
    clf_drop: float = 2.8
    length_ratio_min: float = 0.45
    length_ratio_max: float = 1.20
    number_recall_min: float = 0.90
    variable_recall_min: float = 0.85
    symbol_recall_min: float = 0.80
    max_clean_score_drop: float = 0.20
    min_text_chars: int = 30
    max_link_ratio: float = 0.50
    max_repeat_ratio: float = 0.60
    max_boilerplate_for_drop: int = 5
    fallback_min_raw_score: float = 3.5
    min_post_score_absolute: float = 3.6


def features(text: Column | str) -> dict[str, Column]:
    """The features of FEATURES as expressions over one text column; those of a null text are null."""
    t = col(text)
    ls = stripped_lines(t)
    urls = F.regexp_extract_all(t, F.lit(LINK), F.lit(0))
    variables = F.regexp_extract_all(t, F.lit(VARIABLE), F.lit(1))
    return {
        "char_len": F.length(t),
        "link_ratio": F.round(F.aggregate(urls, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.length(t), F.lit(1)), 4),
        "repeat_ratio": F.round(F.when(F.size(ls) > 0, 1.0 - F.size(F.array_distinct(ls)) / F.size(ls)).otherwise(F.when(t.isNotNull(), 0.0)), 4),
        "boilerplate_hits": F.when(t.isNotNull(), F.size(F.filter(ls, lambda x: found(x, BOILERPLATE_LINE)))),
        "symbol_count": count(t, SYMBOL),
        "latex_cmd_count": count(t, rf"(?U)\\(?:{COMMANDS})\b"),
        "number_count": count(t, NUMBER),
        "variable_like_count": F.when(t.isNotNull(), F.size(F.filter(variables, lambda v: F.lower(v) != "a"))),
        "math_keyword_count": count(t, rf"(?iuU)\b(?:{KEYWORDS})\b|(?:{KEYWORDS_ZH})"),
        "has_problem_solution_signal": found(t, f"(?iuU){PROBLEM}"),
        "has_proof_signal": found(t, f"(?iuU){PROOF}"),
    }


def feature_struct(text: Column | str) -> Column:
    return F.struct(*(v.alias(k) for k, v in features(text).items()))


def _steps(value: Column, *steps: tuple[float, float]) -> Column:
    """The amount of the first threshold that is reached, else 0."""
    out = F.lit(0.0)
    for least, amount in reversed(steps):
        out = F.when(value >= least, F.lit(amount)).otherwise(out)
    return out


def score(f: Column) -> Column:
    """The heuristic score from 0 to 5 of a feature struct, added up in a fixed order and rounded to 4 places."""
    chars, latex, words, numbers, variables = f["char_len"], f["latex_cmd_count"], f["math_keyword_count"], f["number_count"], f["variable_like_count"]
    bare = (latex == 0) & ((words >= 1) | (numbers >= 3))
    total = F.lit(2.5)
    for part in (
        _steps(latex, (5, 1.0), (3, 0.8), (1, 0.4)),
        _steps(words, (4, 0.6), (2, 0.5), (1, 0.2)),
        F.when(f["has_problem_solution_signal"], 0.4).otherwise(0.0),
        F.when(f["has_proof_signal"], 0.3).otherwise(0.0),
        _steps(numbers, (10, 0.3), (5, 0.2)),
        _steps(f["symbol_count"], (10, 0.3), (5, 0.2)),
        _steps(variables, (8, 0.2)),
        -_steps(f["boilerplate_hits"], (5, 0.8), (3, 0.5), (1, 0.2)),
        -_steps(f["link_ratio"], (0.3, 0.6), (0.2, 0.4), (0.1, 0.2)),
        -_steps(f["repeat_ratio"], (0.4, 0.5), (0.3, 0.3)),
        -F.when(chars < 80, 0.3).when(chars < 150, 0.1).otherwise(0.0),
        _steps(chars, (500, 0.2)),
        _steps(chars, (1000, 0.1)),
        F.when(bare & (variables >= 3), 0.3).otherwise(0.0),
        F.when(bare & (numbers >= 5), 0.2).otherwise(0.0),
    ):
        total = total + part
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.round(total, 4)))


def strong_math(f: Column) -> Column:
    return (f["latex_cmd_count"] >= 2) | (f["math_keyword_count"] >= 2) | f["has_problem_solution_signal"] | f["has_proof_signal"] | (f["symbol_count"] >= 5)


def needs_rewrite(f: Column) -> Column:
    """Signs of noise beside some mathematics; for the audit only."""
    noise = (f["boilerplate_hits"] >= 2) | (f["link_ratio"] >= 0.1) | (f["repeat_ratio"] >= 0.15)
    return noise & ((f["latex_cmd_count"] >= 1) | (f["math_keyword_count"] >= 1) | (f["symbol_count"] >= 3))


def hard_drop(f: Column, r: Rules = Rules()) -> Column:
    """Certain rubbish, by the features of the raw text."""
    maths = (f["latex_cmd_count"] > 0) | (f["math_keyword_count"] > 0) | (f["symbol_count"] >= 2) | (f["number_count"] >= 3) | (f["variable_like_count"] >= 3)
    return ((f["char_len"] < r.min_text_chars) & ~maths) | (f["link_ratio"] > r.max_link_ratio) | ((f["boilerplate_hits"] > r.max_boilerplate_for_drop) & ~maths) | ((f["repeat_ratio"] > r.max_repeat_ratio) & (f["char_len"] < 100))


def drop_after_cleaning(raw: Column, cleaned: Column, r: Rules = Rules()) -> Column:
    """Too little left after cleaning, and no mathematics in the raw text (more than two symbols count)."""
    maths = (raw["latex_cmd_count"] > 0) | (raw["math_keyword_count"] > 0) | (raw["symbol_count"] > 2)
    return (F.length(cleaned) < F.greatest(F.lit(1), F.lit(r.min_text_chars))) & ~maths


def route(s: Column, f: Column, r: Rules = Rules()) -> Column:
    strong = strong_math(f)
    return F.when((s >= r.clf_keep) | ((s >= r.clf_keep_with_math) & strong), "keep").when((s < r.clf_drop) & ~strong, "drop").otherwise("llm")
