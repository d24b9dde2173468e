"""Rewards of solutions: correctness, gated quality bonus, penalty for loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.answers import correctness
from tessera.functions.arrow import scalar
from tessera.functions.pytext import col, strip


@dataclass(frozen=True)
class RewardRules:
    """Weights and penalties of the reward."""

    quality_weight: float = 0.05
    quality_gate: float = 3.0
    wrong_boxed: float = -0.9
    wrong_unboxed: float = -1.0
    most_penalty: float = 0.05


def loop_penalty(text: str | None) -> float:
    """For 6- or 8-grams that follow one another: 0.02 for each repetition, at most 0.04; texts below 48 tokens are free."""
    tokens = (text or "").lower().split()
    if len(tokens) < 48:
        return 0.0
    longest = 1
    for n in (6, 8):
        same = [a == b for a, b in zip(tokens, tokens[n:])]  # tokens equal to those n further on
        run = 0
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run // n + 1)
    return min(0.04, 0.02 * (longest - 1))


looping = scalar(loop_penalty, "double")


def line_penalty(text: Column | str) -> Column:
    """0.01 for each repeated line of at least 20 characters, at most 0.03."""
    ls = F.filter(F.transform(F.split(col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.lower(strip(x))), lambda x: F.length(x) >= 20)
    return F.least(F.lit(0.03), 0.01 * (F.size(ls) - F.size(F.array_distinct(ls))))


def repetition_penalty(text: Column | str, most: float = 0.05) -> Column:
    return F.coalesce(F.least(looping(col(text)) + line_penalty(text), F.lit(most)), F.lit(0.0))


def quality_reward(raw: Column, gate: float = 3.0) -> Column:
    """A quality score's excess over the gate, halved."""
    return F.greatest(F.lit(0.0), (raw - gate) / 2)


def reward(text: Column | str, gt: Column | str, raw_quality: Column | None = None, r: RewardRules = RewardRules()) -> Column:
    """The reward of a solution and its parts as a struct; without a quality score that part is 0."""
    v = correctness(col(text), col(gt))
    raw = F.coalesce(raw_quality, F.lit(0.0)) if raw_quality is not None else F.lit(0.0)
    right = v["acc"]
    outcome = F.when(right, 1.0).otherwise(0.0)
    wrong = F.when(right, 0.0).otherwise(r.wrong_unboxed)
    form = F.when(~right & v["has_boxed"], max(0.0, r.wrong_boxed - r.wrong_unboxed)).otherwise(0.0)
    base = outcome + wrong + form
    fm = quality_reward(raw, r.quality_gate)
    bonus = F.when(right | v["near_correct"], r.quality_weight * fm).otherwise(0.0)
    penalty = repetition_penalty(text, r.most_penalty)
    total = base + bonus - penalty
    parts = {
        "score": total, "total_reward": total, "acc": right, "near_correct": v["near_correct"], "pred": v["pred"], "has_boxed": v["has_boxed"], "correctness_reward": base, "base_reward": base, "outcome_reward": outcome, "format_reward": form,
        "incorrect_penalty": wrong, "parseable_answer": v["pred"] != "[INVALID]", "fm_reward": fm, "fm_raw_score": raw, "fm_bonus": bonus, "repetition_penalty": penalty, "total_reward_before_penalty": base + bonus, "repetition_penalized": penalty > 0,
    }
    return F.struct(*(c.alias(n) for n, c in parts.items()))


