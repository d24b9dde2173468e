"""String expressions with Python's meaning: Unicode white space, lines, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.words import SPACES

#: All characters of white space.
WHITE = "".join(chr(x) for a, b in SPACES for x in range(a, b + 1))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(c), F.lit(WHITE))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def stripped_lines(c: Column | str) -> Column:
    """The non-blank lines, stripped."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def found(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def number(c: Column | str) -> Column:
    """A plain decimal number as a double, else null: no letters, so that ``1d`` and ``nan`` are no numbers."""
    c = col(c)
    return F.when(c.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), c.try_cast("double"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(c: Column) -> Column:
    """The same value, which the optimizer may not copy into later expressions or filters."""
    return F.when(F.rand(0) >= 0.0, c)


def any_of(*patterns: str) -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return "|".join(f"(?:{p})" for p in patterns)


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible random order: the hash of a seed and the keys."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible number in [0, 1) for each key."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 12), 16, 10).cast("double") / float(16**12)
