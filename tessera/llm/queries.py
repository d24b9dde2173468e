"""Queries of the operators on training text, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import leakage, mainbody, markup, packing, pairs, quality, quota_sample, repetition, residue
from tessera.sources.tables import table


def records(spark: SparkSession, base: str, generated: str) -> DataFrame:
    """(rec_table, rec_key, text) of the sample pages and of one text column of the generations."""
    pages = table(spark, base, "sample_input").select(F.lit("sample_input").alias("rec_table"), F.col("id").alias("rec_key"), "text")
    made = table(spark, base, "warmstart_generations").select(F.lit("warmstart_generations").alias("rec_table"), F.col("gen_id").cast("string").alias("rec_key"), F.col(generated).alias("text"))
    return pages.unionByName(made)


def _plans(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, base, "dpo_questions_24k_v2").select(F.col("question_id").alias("id"), "category", F.when(F.isnan("student_accuracy"), None).otherwise(F.floor(F.col("student_accuracy") * 4)).cast("int").alias("band"))
    plans = table(spark, base, "category_targets")
    return quota_sample.available(rows, plans), plans


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return quota_sample.report(*_plans(spark, base)).where("missing > 0").select("plan_id", "category_id")


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    return quota_sample.report(*_plans(spark, base)).drop("bands")


def p1_sample(spark: SparkSession, base: str) -> DataFrame:
    held, plans = _plans(spark, base)
    return quota_sample.draw(held, quota_sample.report(held, plans)).withColumnRenamed("id", "question_id")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return repetition.repeated(records(spark, base, "continuation")).select("rec_table", "rec_key")


def p2_perplexity(spark: SparkSession, base: str) -> DataFrame:
    return repetition.perplexity(records(spark, base, "continuation"))


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sample_input").select("id", "text")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return quality.not_prose(_pages(spark, base))


def p3_statistics(spark: SparkSession, base: str) -> DataFrame:
    return quality.kinds(_pages(spark, base), table(spark, base, "light_rule_result"))


def p3_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return quality.placed(quality.measured(_pages(spark, base)))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return markup.residue(records(spark, base, "full_response"))


def p4_clean(spark: SparkSession, base: str) -> DataFrame:
    return markup.cleaned(records(spark, base, "full_response"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return pairs.defects(table(spark, base, "warmstart_generations"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return mainbody.furniture_lines(_pages(spark, base))


def p6_bodies(spark: SparkSession, base: str) -> DataFrame:
    return mainbody.bodies(_pages(spark, base)).drop("furniture")


def p7_pack(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", packing.token_count("text").alias("tokens"))
    return packing.pack(docs, table(spark, base, "context_windows").select("window_id", F.col("capacity_tokens").alias("capacity")))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return p7_pack(spark, base).where("parts > 1").select("window_id", "doc_id").distinct()


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers of each kind, and how full they are."""
    used = p7_pack(spark, base).groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens"))
    kinds = table(spark, base, "context_windows").select("window_id", "capacity_tokens")
    return used.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).join(kinds, "window_id").withColumn("fill", F.expr("tokens / (containers * capacity_tokens)"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return leakage.leaks(table(spark, base, "documents"), table(spark, base, "eval_items"), "doc_id", "text", "item_id", ["problem", "solution"])


def p8_items(spark: SparkSession, base: str) -> DataFrame:
    """How many documents each leaked item turned up in."""
    return p8_found(spark, base).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.excluded(table(spark, base, "documents")).select("doc_id")


def p9_reasons(spark: SparkSession, base: str) -> DataFrame:
    return residue.excluded(table(spark, base, "documents"))


def p9_validation(spark: SparkSession, base: str) -> DataFrame:
    """How the classifier does on passages of hosts it was not trained on."""
    told = residue.fit(table(spark, base, "documents"))[1]
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{k} double" for k in told))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_sample, p2_found, p2_perplexity, p3_found, p3_statistics, p3_percentiles, p4_found, p4_clean, p5_found, p6_found, p6_bodies, p7_found, p7_pack, p7_fill, p8_found, p8_items, p9_found, p9_reasons, p9_validation)
}
