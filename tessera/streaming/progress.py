"""The state of learning progress kept over a stream of observations.

The stream keeps counts of each sample's steps, added up before they are shuffled, so that late rows count and a
sample with many rows is no large task. Moving averages depend on the order of steps; they are folded from the
counts when the state is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import progress

KEYS = ("sample_id", "is_pg", "step")


def step_counts(observations: DataFrame) -> DataFrame:
    """(sample_id, is_pg, step, n, n_good): rows and positive rewards of each step, for a stream or a table.

    Null ids and steps give no row; null rewards are not positive, null flags not guided.
    """
    df = observations.where("sample_id is not null and step is not null").withColumn("is_pg", F.coalesce("is_pg", F.lit(False)))
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("reward") > 0).alias("n_good"))


def run_available(observations: DataFrame, out: str, checkpoint: str) -> None:
    """Runs over what the stream has now; each batch writes the counts it changed to a folder of its own.

    A repeated batch overwrites its folder, so it does no harm.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = step_counts(observations).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rates(out: DataFrame) -> DataFrame:
    """(sample_id, is_pg, step, rate) from the batches written (with column batch): the last count of each step."""
    last = out.groupBy(*KEYS).agg(F.max_by(F.struct("n", "n_good"), "batch").alias("c"))
    return last.select(*KEYS, (F.col("c.n_good") / F.col("c.n")).alias("rate"))


def latest(out: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """The state of each sample after all batches, as over a table of the same rows; from ``states`` or from nothing."""
    return progress.updated(rates(out), states)
