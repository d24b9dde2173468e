"""Learning progress per sample: pass rates, moving averages, weights, categories and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import on_disk

#: Weight of a new observation, slope of the weight, its offset.
BETA, KAPPA, OFFSET = 0.8, 8.0, 0.5


def initial(students: DataFrame) -> DataFrame:
    """(sample_id, p, lp, n_updates) from (sample_id, row_idx, num_correct, num_total); the last row of a sample wins."""
    last = students.groupBy("sample_id").agg(F.max_by(F.struct("num_correct", "num_total"), "row_idx").alias("r"))
    return last.select("sample_id", (F.col("r.num_correct") / F.greatest(F.col("r.num_total"), F.lit(1))).alias("p"), F.lit(0.0).alias("lp"), F.lit(1).alias("n_updates"))


def step_rates(observations: DataFrame) -> DataFrame:
    """(sample_id, is_pg, step, rate): share of positive rewards of each step; null rewards are not positive, null flags not guided.

    Two levels of partial aggregates: a sample with a tenth of all rows combines before the shuffle.
    """
    df = observations.where("sample_id is not null and step is not null")
    return df.groupBy("sample_id", F.coalesce("is_pg", F.lit(False)).alias("is_pg"), "step").agg(F.avg(F.when(F.col("reward") > 0, 1.0).otherwise(0.0)).alias("rate"))


def fold(steps: Column, p: Column, lp: Column, n: Column, beta: float = BETA) -> Column:
    """The state (p, lp, n) after a sorted array of (step, rate): the first rate is taken as it is, then averaged in."""
    start = F.struct(p.alias("p"), lp.alias("lp"), n.alias("n"))

    def advance(s: Column, x: Column) -> Column:
        moved = beta * s["p"] + (1 - beta) * x["rate"]
        new = F.when(s["n"] == 0, x["rate"]).otherwise(moved)
        return F.struct(new.alias("p"), F.when(s["n"] == 0, F.lit(0.0)).otherwise(new - s["p"]).alias("lp"), (s["n"] + 1).alias("n"))

    return F.aggregate(steps, start, advance)


def updated(rates: DataFrame, states: DataFrame | None = None, beta: float = BETA) -> DataFrame:
    """(sample_id, p, lp, n_updates, pg_p_ema, pg_seen) after all steps of ``rates``, from ``states`` or from nothing.

    Guided steps move only the guided average. A sample that was only guided has p 0 and no updates. One row
    per sample and step remains, so a state folds over its steps, not over its rows.
    """
    steps = lambda pg: F.array_sort(F.collect_list(F.when(F.col("is_pg") == F.lit(pg), F.struct("step", "rate"))))
    seen = rates.groupBy("sample_id").agg(steps(False).alias("free"), steps(True).alias("guided"))
    df = seen.join(states, "sample_id", "full_outer") if states is not None else seen
    had = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if states is not None and c in states.columns else F.lit(d)
    none = F.array().cast("array<struct<step: bigint, rate: double>>")
    free = fold(F.coalesce(F.col("free").cast("array<struct<step: bigint, rate: double>>"), none), had("p", 0.0), had("lp", 0.0), had("n_updates", 0).cast("int"), beta)
    guided = fold(F.coalesce(F.col("guided").cast("array<struct<step: bigint, rate: double>>"), none), had("pg_p_ema", 0.0), F.lit(0.0), had("pg_seen", 0).cast("int"), beta)
    return df.select("sample_id", free.alias("a"), guided.alias("b")).select("sample_id", "a.p", "a.lp", F.col("a.n").alias("n_updates"), F.when(F.col("b.n") > 0, F.col("b.p")).alias("pg_p_ema"), F.when(F.col("b.n") > 0, F.col("b.n")).alias("pg_seen"))


def first_steps(rates: DataFrame, n: int) -> DataFrame:
    """The first ``n`` steps of each sample and kind of ``rates``: what was known then. One row for each step, so groups are small."""
    firsts = rates.groupBy("sample_id", "is_pg").agg(F.slice(F.array_sort(F.collect_list(F.struct("step", "rate"))), 1, n).alias("_s"))
    return firsts.select("sample_id", "is_pg", F.inline("_s"))


def weight(lp: Column, kappa: float = KAPPA, offset: float = OFFSET) -> Column:
    """From 0.5 to 1.5 by progress; an unknown sample weighs 1."""
    return F.coalesce(1 / (1 + F.exp(-kappa * lp)) + offset, F.lit(1.0))


def documented_weight(p: Column, lp: Column, low: float = 0.5, high: float = 1.5, k: float = 10.0, tau: float = 0.08) -> Column:
    """The weight as written down elsewhere: progress and closeness to one half together."""
    s = 0.7 * F.greatest(lp, F.lit(0.0)) + 0.3 * 4 * p * (1 - p)
    return low + (high - low) / (1 + F.exp(-k * (s - tau)))


def weighted_advantages(tokens: DataFrame, states: DataFrame) -> DataFrame:
    """``tokens`` (sample_id, advantages, ...) with each advantage times its sample's weight."""
    df = tokens.join(states.select("sample_id", "lp"), "sample_id", "left").withColumn("lp_weight", weight(F.col("lp")))
    return df.withColumn("advantages", F.transform("advantages", lambda a: a * F.col("lp_weight"))).drop("lp")


def summary(states: DataFrame) -> DataFrame:
    p = F.col("p")
    return states.agg(F.count("*").alias("n"), F.avg("p").alias("avg_p"), F.avg("lp").alias("avg_lp"), F.count_if(p < 0.05).alias("n_hard"), F.count_if(p.between(0.1, 0.5)).alias("n_sweet"), F.count_if(p > 0.8).alias("n_mastered"), F.avg(weight(F.col("lp"))).alias("avg_weight"))


CONFIG = {"beta": BETA, "kappa": KAPPA, "b": OFFSET}


def save_states(states: DataFrame, path: str, config: dict[str, float] | None = None) -> None:
    """A snapshot: the states as a table, and beside them one row with the configuration and the summary."""
    states.write.mode("overwrite").parquet(f"{path}/states")
    kept = states.sparkSession.read.parquet(f"{path}/states")
    told = F.struct(*(F.lit(v).cast("double").alias(k) for k, v in (config or CONFIG).items()))
    about = summary(kept)
    about.select(told.alias("config"), F.struct(*about.columns).alias("summary")).write.mode("overwrite").json(f"{path}/about")


def load_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The states of a snapshot; None if there is none. The configuration stays with the caller."""
    files, place = on_disk(spark, f"{path}/states")
    return spark.read.parquet(f"{path}/states") if files.exists(place) else None


def labels(p: Column, lp: Column) -> Column:
    """The categories of a state: one by p, and learning where it rises between .15 and .8."""
    base = F.when(p < 0.05, "hard_zero").when(p < 0.15, "struggling").when(p > 0.8, "mastered").when(p <= 0.5, "sweet_spot")
    return F.array_compact(F.array(base, F.when(p.between(0.15, 0.8) & (lp > 0), "learning")))


def categories(states: DataFrame) -> DataFrame:
    return states.select("sample_id", "p", "lp", F.explode(labels(F.col("p"), F.col("lp"))).alias("category"))


def guided_candidates(states: DataFrame) -> DataFrame:
    """Samples at most .05 right after two updates, without progress."""
    return states.where("p <= 0.05 and n_updates >= 2 and lp <= 0.01")


def cycle(rows: DataFrame, states: DataFrame, shares: dict[str, float], total: int, seed: int | str = 0) -> DataFrame:
    """(sample_id, category): the next cycle, a share of each category, 'exploration' from samples without state.

    A sample may come in two categories. A shortfall is filled from sweet_spot and learning, which may repeat.
    """
    from tessera.functions.pytext import hash_order
    from tessera.operators.selection import case_of, cut_points, prefix_cut

    ids = rows.select("sample_id").where("sample_id is not null").distinct()
    known = ids.join(categories(states).select("sample_id", "category"), "sample_id")
    new = ids.join(states.select("sample_id"), "sample_id", "left_anti").withColumn("category", F.lit("exploration"))
    pool = known.unionByName(new).withColumn("_order", hash_order(seed, "sample_id", "category"))
    quota = case_of({c: int(total * r) for c, r in shares.items()}, "category", 0)
    cuts = cut_points(pool.withColumn("_q", quota).where("_q > 0"), ["category"], "_order", F.col("_q"))
    picked = pool.join(F.broadcast(cuts), "category").where("_order <= _cut").select("sample_id", "category")
    short = total - picked.count()
    if short <= 0:
        return picked
    more = pool.where(F.col("category").isin("sweet_spot", "learning")).withColumn("_code", F.concat(F.lit("000"), hash_order(f"{seed}+", "sample_id", "category")))
    stop = prefix_cut(more, "_code", short)
    return picked.unionByName((more if stop is None else more.where(F.col("_code") <= stop)).select("sample_id", "category"))


def guided_rows(candidates: DataFrame, questions: DataFrame, most: int, seed: int | str = 0) -> DataFrame:
    """(sample_id, prompt, prefix, prefix_ratio): up to ``most`` candidates with a safe prefix of their reference answer.

    ``questions`` has sample_id, question, answer and ground_truth; the ratio is drawn by hash from .15 to .55.
    """
    from tessera.functions.pytext import hash_order, uniform
    from tessera.functions.similarity import guided_prefix
    from tessera.operators.preference import SYSTEM, messages
    from tessera.operators.selection import prefix_cut

    u, v = uniform(f"{seed}tier", "sample_id"), uniform(f"{seed}ratio", "sample_id")
    low = F.when(u < 0.5, 0.15).when(u < 0.85, 0.25).otherwise(0.40)
    width = F.when(u < 0.5, 0.10).otherwise(0.15)
    df = questions.select("sample_id", "question", "answer", "ground_truth").dropDuplicates(["sample_id"]).join(candidates.select("sample_id").distinct(), "sample_id")
    df = df.withColumn("prefix_ratio", F.round(low + width * v, 6)).withColumn("prefix", guided_prefix(F.col("answer"), F.col("ground_truth"), F.col("prefix_ratio"))).where("prefix is not null")
    coded = df.withColumn("_code", F.concat(F.lit("000"), hash_order(seed, "sample_id")))
    stop = prefix_cut(coded, "_code", most)
    kept = coded if stop is None else coded.where(F.col("_code") <= stop)
    return kept.select("sample_id", messages(("system", F.lit(SYSTEM)), ("user", F.col("question")), ("assistant", F.col("prefix"))).alias("prompt"), "prefix", "prefix_ratio")
