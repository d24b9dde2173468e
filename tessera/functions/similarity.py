"""Prefixes of solutions and likeness of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrow import scalar
from tessera.functions.pytext import col, let

#: Ends of displayed formulas, blank lines, items, numbered items and bold headings; every line end counts besides.
BREAKS = re.compile(r"\n")
LEADS = [re.compile(p) for p in (r"\$\$\s*\n", r"\n\s*\n", r"\n\s*[-*]\s", r"\n\s*\d+[.)]\s", r"\n\s*\*\*")]
TIERS = {"short": 0.2, "mid": 0.4, "long": 0.6}


def breakpoints(text: str) -> list[int]:
    """Where a prefix may end."""
    return sorted({m.end() for p in (BREAKS, *LEADS) for m in p.finditer(text)})


def cut(text: str, ratio: float, ends: list[int]) -> str | None:
    """The prefix whose end lies nearest to ``ratio`` of the text; it must lie between 5 % and 80 %, or there is none."""
    n = len(text)
    target = int(n * ratio)
    for pool in (ends, [e for e in ends if 0.05 * n <= e <= 0.8 * n]):
        if pool:
            best = min(pool, key=lambda e: (abs(e - target), e))
            if 0.05 * n <= best <= 0.8 * n:
                return text[:best]
    return None


def equation(gt: str) -> re.Pattern:
    return re.compile(r"=\s*" + re.escape(gt) + r"\s*[\n$\\,.]")


def leaks(prefix: str, gt: str) -> bool:
    """Whether a prefix boxes the reference, or sets something equal to a plain number in its last fifth."""
    gt = gt.strip()
    if "\\boxed{" + gt + "}" in prefix:
        return True
    return bool(re.fullmatch(r"-?\d+\.?\d*", gt)) and bool(equation(gt).search(prefix[int(len(prefix) * 0.8) :]))


def before_leak(prefix: str, gt: str, ends: list[int]) -> str:
    """The prefix cut at the last break before it leaks, else 50 characters before, but not below 30 %."""
    gt = gt.strip()
    at = prefix.find("\\boxed{" + gt + "}")
    if at < 0:
        m = equation(gt).search(prefix)
        at = m.start() if m and m.start() > 0.8 * len(prefix) else -1
    if at < 0:
        return prefix
    earlier = [e for e in ends if e < at]
    return prefix[: earlier[-1]] if earlier else prefix[: max(at - 50, int(len(prefix) * 0.3))]


def safe_prefix(text: str | None, gt: str | None, ratio: float, least: int) -> str | None:
    """A prefix of about ``ratio`` that does not leak and has at least ``least`` characters, else None."""
    if not text or gt is None:
        return None
    ends = breakpoints(text)
    p = cut(text, ratio, ends)
    if p is None or len(p) < least:
        return None
    if leaks(p, gt):
        p = before_leak(p, gt, [e for e in ends if e <= len(p)])
    return p if len(p) >= least else None


def _tiered(text: str | None, gt: str | None) -> dict | None:
    """Prefixes of three lengths; null unless all three exist."""
    out = {k: safe_prefix(text, gt, r, 20) for k, r in TIERS.items()}
    return out if all(v is not None for v in out.values()) else None


tiered_prefixes = scalar(_tiered, "struct<short: string, mid: string, long: string>")
guided_prefix = scalar(lambda text, gt, ratio: safe_prefix(text, gt, ratio, 30), "string")


def shingles(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def shares_run(a: Column | str, b: Column | str, n: int = 51, most: int = 3000) -> Column:
    """Whether the first ``most`` characters of two texts share ``n`` in a row.

    Such a run of the second text holds one of its blocks of (n + 1) // 2 characters at multiples of that
    length; all runs are compared only where the first text has one of those blocks.
    """
    size = (n + 1) // 2

    def compare(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length(x["b"]) / size) - 1).cast("int"))
        some = F.exists(starts, lambda i: (F.length(x["b"]) >= size) & F.contains(x["a"], F.substring(x["b"], i * size + 1, F.lit(size))))
        return F.when(some, F.arrays_overlap(shingles(x["a"], n), shingles(x["b"], n))).otherwise(F.lit(False))

    return F.coalesce(let(F.struct(F.substring(col(a), 1, most).alias("a"), F.substring(col(b), 1, most).alias("b")), compare), F.lit(False))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = 0
    for w in b:
        hit = row | at.get(w, 0)
        row = hit & (hit ^ (hit - (row << 1 | 1)))
    return row.bit_count()


def rouge_l(a: str | None, b: str | None, most: int = 500) -> float:
    """F1 of the longest common subsequence of the first ``most`` words; 0 where either text has none."""
    x, y = (a or "").split()[:most], (b or "").split()[:most]
    n = common_subsequence(x, y) if x and y else 0
    return 2 * n / (len(x) + len(y)) if n else 0.0


rouge = scalar(rouge_l, "double")

