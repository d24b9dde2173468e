"""A sample whose category shares follow given targets.

Weights are raked by iterative proportional fitting over two margins (the target category and a second
attribute), rows get weighted exponential keys, each category gives its smallest keys, minimums are repaired,
and what could not be met is reported. A row is available to a category if its label equals one of the
category's names once full-width forms, white space and case are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Full-width forms and the plain characters they stand for (Unicode's fixed mapping).
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000) + "".join(map(chr, (0xFFE0, 0xFFE1, 0xFFE2, 0xFFE5)))
PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " " + "".join(map(chr, (0xA2, 0xA3, 0xAC, 0xA5)))
#: Names that one broadcast holds; a larger plan table is joined by shuffle.
BROADCAST_NAMES = 200_000
LEVELS, BITS = 2, 12


def plain(name: Column) -> Column:
    """The name with full-width forms made plain, without white space, in lower case."""
    return F.lower(F.regexp_replace(F.translate(name, WIDE, PLAIN), r"(?U)\s+", ""))


def names(plans: DataFrame) -> DataFrame:
    """(key, targets): for each spelling, the (plan_id, category_id) pairs it stands for."""
    each = plans.where("plan_id is not null and category_id is not null").select("plan_id", "category_id", F.explode(F.array_distinct(F.array(plain(F.col("category")), plain(F.col("name_en"))))).alias("key"))
    return each.where("key is not null and key <> ''").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("plan_id", "category_id"))).alias("targets"))


def available(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(id, band, targets): each distinct id with the (plan_id, category_id) pairs it is available to.

    ``rows`` has id, category and band. Null and blank categories belong to none. Of repeated rows the least
    band counts; an id with several spellings of one category counts once.
    """
    keys = names(plans)
    keys = F.broadcast(keys) if plans.count() <= BROADCAST_NAMES else keys
    labelled = rows.where("id is not null").select("id", "band", plain(F.col("category")).alias("key")).where("key <> ''")
    held = labelled.join(keys, "key").groupBy("id").agg(F.min("band").alias("band"), F.collect_set("targets").alias("sets"))
    return held.select("id", F.coalesce("band", F.lit(-1)).alias("band"), F.array_distinct(F.flatten("sets")).alias("targets"))


def rake(counts: dict[tuple, float], rows: dict, columns: dict, rounds: int = 200, close: float = 1e-9) -> dict[tuple, float]:
    """Cell weights by iterative proportional fitting: ``counts`` of (row, column) cells scaled to both margins.

    A margin without any cell is left out; a margin that the cells cannot reach keeps its nearest value.
    """
    fitted = dict(counts)
    for _ in range(rounds):
        worst = 0.0
        for side, wanted in ((0, rows), (1, columns)):
            sums: dict = {}
            for cell, v in fitted.items():
                sums[cell[side]] = sums.get(cell[side], 0.0) + v
            for cell in fitted:
                total, aim = sums[cell[side]], wanted.get(cell[side], 0.0)
                factor = aim / total if total > 0 else 0.0
                worst = max(worst, abs(factor - 1))
                fitted[cell] *= factor
        if worst < close:
            break
    return {c: fitted[c] / n if n else 0.0 for c, n in counts.items()}


def quotas(want: dict, least: dict, have: dict, total: int) -> dict:
    """Whole numbers per category: targets by largest remainder, minimums repaired, bounded by what exists.

    What a scarce category lacks is dealt to the categories with rows left, in proportion to their targets.
    """
    floor = {c: min(have[c], math.floor(v)) for c, v in want.items()}
    for c in sorted(want, key=lambda c: (math.floor(want[c]) - want[c], str(c))):
        if sum(floor.values()) < total and floor[c] < have[c]:
            floor[c] += 1
    given = {c: min(have[c], max(floor[c], least[c])) for c in want}
    while (gap := total - sum(given.values())) > 0 and (open_ := [c for c in sorted(want, key=lambda c: (-want[c], str(c))) if given[c] < have[c]]):
        weight = sum(want[c] for c in open_) or len(open_)
        for c in open_:
            gap = total - sum(given.values())
            given[c] += max(0, min(have[c] - given[c], gap, math.ceil(gap * (want[c] or 1) / weight)))
    while (over := sum(given.values()) - total) > 0 and (rich := [c for c in sorted(want, key=lambda c: (-(given[c] - want[c]), str(c))) if given[c] > least[c]]):
        given[rich[0]] -= 1 if over < 64 else min(given[rich[0]] - least[rich[0]], -(-over // len(rich)))
    return given


REPORT = "plan_id int, category_id int, target_share double, min_rows bigint, sample_rows bigint, available bigint, needed bigint, drawn bigint, missing bigint, share double, gap double, bands array<struct<band: int, weight: double>>"


def report(held: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per target: what is available, needed and drawn, how far the share is off, and the raked weights.

    needed is the larger of min_rows and target_share x sample_rows (to four decimals, then rounded up);
    missing is how many rows fall short of it. Null numbers of a plan count as 0.
    """
    cells = held.select("band", F.explode("targets").alias("t")).groupBy("t.plan_id", "t.category_id", "band").agg(F.count("*").alias("n"))
    asked = plans.where("plan_id is not null and category_id is not null").groupBy("plan_id", "category_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_share", "min_rows", "sample_rows")))
    joined = asked.join(cells, ["plan_id", "category_id"], "left").select(
        F.col("plan_id").cast("int").alias("plan_id"), F.col("category_id").cast("int").alias("category_id"), F.col("target_share").cast("double").alias("target_share"), F.col("min_rows").cast("long").alias("min_rows"), F.col("sample_rows").cast("long").alias("sample_rows"), "band", F.coalesce("n", F.lit(0)).alias("n")
    )
    arrow = to_arrow_schema(StructType.fromDDL(REPORT))

    def plan(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ask = {r["category_id"]: r for r in rows}
        total = max(r["sample_rows"] for r in rows)
        counts = {(r["category_id"], r["band"]): float(r["n"]) for r in rows if r["n"]}
        have = {c: sum(int(n) for (k, _), n in counts.items() if k == c) for c in ask}
        want = {c: a["target_share"] * a["sample_rows"] for c, a in ask.items()}
        pool = sum(counts.values()) or 1.0
        reach = sum(v for c, v in want.items() if have[c])
        columns: dict = {}
        for (_, b), n in counts.items():
            columns[b] = columns.get(b, 0.0) + n / pool * reach
        weight = rake(counts, {c: v for c, v in want.items() if have[c]}, columns)
        given = quotas(want, {c: min(have[c], a["min_rows"]) for c, a in ask.items()}, have, total)
        drawn = sum(given.values()) or 1
        out = []
        for c, a in sorted(ask.items()):
            needed = max(a["min_rows"], math.ceil(round(a["target_share"] * a["sample_rows"], 4)))
            bands = [{"band": b, "weight": w} for (k, b), w in sorted(weight.items()) if k == c]
            out.append((a["plan_id"], c, a["target_share"], a["min_rows"], a["sample_rows"], have[c], needed, given[c], max(0, needed - have[c]), given[c] / drawn, given[c] / drawn - a["target_share"], bands))
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return joined.groupBy("plan_id").applyInArrow(plan, REPORT)


def smallest(keyed: DataFrame, group: list[str], code: str, tie: str, quota: str) -> DataFrame:
    """Rows with the ``quota`` smallest codes of their group, without sorting a whole group in one task.

    Codes are whole numbers below 2**60. Counts of code prefixes show in which bucket the quota runs out;
    twice in turn only that bucket is looked into, and what remains of it is ranked, ties by ``tie``.
    """
    taken, rest = [], keyed.withColumn("_left", F.col(quota).cast("long"))
    for level in range(LEVELS):
        rest = rest.withColumn("_bucket", F.shiftright(F.col(code), 60 - BITS * (level + 1)))
        counts = rest.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"), F.max("_left").alias("_q"))
        upto = F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket"))
        edge = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n")).where("_before < _q")
        edge = edge.groupBy(*group).agg(F.max("_bucket").alias("_edge"), F.max_by("_before", "_bucket").alias("_before"))
        marked = rest.join(edge, group)
        taken.append(marked.where("_bucket < _edge").select(*keyed.columns))
        rest = marked.where("_bucket = _edge").withColumn("_left", F.col("_left") - F.col("_before")).select(*keyed.columns, "_left")
    ranked = rest.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(code, tie)))
    taken.append(ranked.where("_rank <= _left").select(*keyed.columns))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def draw(held: DataFrame, told: DataFrame, seed: int = 0) -> DataFrame:
    """(plan_id, category_id, id): for each target the ``drawn`` rows with the smallest weighted exponential keys."""
    each = held.select("id", "band", F.explode("targets").alias("t")).select("id", "band", "t.plan_id", "t.category_id")
    weights = told.select("plan_id", "category_id", "drawn", F.explode("bands").alias("b")).select("plan_id", "category_id", "drawn", "b.band", "b.weight")
    u = (F.pmod(F.xxhash64(F.lit(seed), "plan_id", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    code = ((1 - F.pow(u, 1 / F.greatest("weight", F.lit(1e-12)))) * float((1 << 60) - 1024)).cast("long")
    keyed = each.join(weights, ["plan_id", "category_id", "band"]).select("plan_id", "category_id", "id", "drawn", code.alias("code"))
    return smallest(keyed, ["plan_id", "category_id"], "code", "id", "drawn").select("plan_id", "category_id", "id")
