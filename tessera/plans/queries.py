"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers, evaluation, features, reward, similarity, tokens, validation
from tessera.functions.cleaning import drop_repeats, with_clean_text
from tessera.functions.pytext import let, once, strip, uniform
from tessera.operators import cleaner, extract, preference, progress, segment, selection
from tessera.sources import files
from tessera.sources.tables import shared_folder, spread, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dpo_questions_24k_v2").withColumn("acc", F.when(~F.isnan("student_accuracy"), F.col("student_accuracy")))


def students(s: SparkSession, d: str) -> DataFrame:
    """Students' rows once each, counts taken from the responses."""
    df = selection.first_per_key(table(s, d, "student_responses"), selection.key_raw("question"), "row_idx")
    counted = preference.pass_counts(F.col("responses"))
    return df.withColumn("num_correct", counted["num_correct"]).withColumn("num_total", counted["num_total"])


def generations(s: SparkSession, d: str) -> DataFrame:
    return selection.first_per_key(table(s, d, "warmstart_generations"), F.col("gen_id"), "row_idx")


# --- cleaning ------------------------------------------------------------------------------------------------


@query
def doc_features(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "sample_input").where("text is not null").select("row_idx", "text")).select("row_idx", *(c.alias(n) for n, c in features.features("text").items()))


def _scored(s: SparkSession, d: str) -> DataFrame:
    df = spread(docs(s, d).select("doc_id", "text")).select("doc_id", once(features.feature_struct("text")).alias("f"))
    return df.withColumn("score", once(features.score(F.col("f")))).withColumn("route", features.route(F.col("score"), F.col("f")))


@query
def doc_scores(s: SparkSession, d: str) -> DataFrame:
    f = F.col("f")
    return _scored(s, d).select("doc_id", "score", "route", features.strong_math(f).alias("strong"), features.needs_rewrite(f).alias("rewrite"), features.hard_drop(f).alias("dropped"))


@query
def route_histogram(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query
def adjacent_line_dedup(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", drop_repeats(F.col("text")).alias("text"))


@query
def clean_pages(s: SparkSession, d: str) -> DataFrame:
    return with_clean_text(spread(table(s, d, "sample_input").select("row_idx", "text").where("text is not null")), "text", "clean").select("row_idx", F.col("clean").alias("text"))


@query
def segments(s: SparkSession, d: str) -> DataFrame:
    return segment.segment_documents(table(s, d, "sample_input").select("id", "text"))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    pages = selection.first_per_key(table(s, d, "sample_input"), F.col("id"), "row_idx")
    return cleaner.clean_documents(spread(pages.select("id", "text")))


@query
def route_audit(s: SparkSession, d: str) -> DataFrame:
    return cleaner.audit(_cleaned(s, d)).withColumn("fail_reasons", F.to_json("fail_reasons"))


@query
def train_output(s: SparkSession, d: str) -> DataFrame:
    return cleaner.output(_cleaned(s, d))


@query
def audit_summary(s: SparkSession, d: str) -> DataFrame:
    return cleaner.summary(cleaner.audit(_cleaned(s, d)))


@query
def recall_checks(s: SparkSession, d: str) -> DataFrame:
    """Checks of each generation's continuation against its full response."""
    a, b = F.col("full_response"), F.col("continuation")
    df = generations(s, d).where("continuation is not null")
    return df.select("gen_id", F.round(validation.number_recall(a, b), 6).alias("numbers"), F.round(validation.symbol_recall(a, b), 6).alias("symbols"), validation.brackets_kept(a, b).alias("brackets"), validation.latex_kept(a, b).alias("latex"))


@query
def validated_rewrites(s: SparkSession, d: str) -> DataFrame:
    df = generations(s, d).where("continuation is not null").withColumn("score", let(features.feature_struct("full_response"), features.score))
    return df.select("gen_id", validation.validate(F.col("full_response"), F.col("continuation"), F.col("score")).alias("v")).select("gen_id", "v.validation_pass", "v.number_recall", "v.variable_recall", "v.symbol_recall", "v.score_post", F.to_json("v.fail_reasons").alias("reasons"))


@query
def resume_antijoin(s: SparkSession, d: str) -> DataFrame:
    done = docs(s, d).where("int_score >= 3").select(F.concat(F.col("doc_id").cast("string"), F.lit("_seg_0001")).alias("id"))
    return cleaner.resume(docs(s, d).select(F.col("doc_id").alias("id"), "lang"), done).select("id", "lang")


@query
def corpus_prefilter(s: SparkSession, d: str) -> DataFrame:
    return files.corpus_filter(docs(s, d), 3).select("doc_id", "int_score", "token_count")


# --- questions -----------------------------------------------------------------------------------------------


@query
def prefix_dedup(s: SparkSession, d: str) -> DataFrame:
    return selection.first_per_key(questions(s, d).withColumn("qkey", selection.key_strip("question")), F.col("qkey"), "row_idx").select("row_idx", "qkey")


@query
def last_wins(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select(selection.key_raw("question").alias("qkey"), "row_idx", "ground_truth")
    return selection.last_per_key(df, "qkey", "row_idx").select("qkey", "row_idx", "ground_truth")


@query
def subject_histogram(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select(selection.classify("question").alias("subject"), selection.classify("question", selection.SUBJECTS_SHORT, selection.EXCLUDED_SHORT).alias("short"))
    return df.groupBy("subject", "short").agg(F.count("*").alias("n"))


@query
def reject_cascade(s: SparkSession, d: str) -> DataFrame:
    df = selection.rejected_for_pairs(questions(s, d))
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def reject_cascade_training(s: SparkSession, d: str) -> DataFrame:
    df = selection.rejected_for_training(questions(s, d))
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def next_round_pool(s: SparkSession, d: str) -> DataFrame:
    used = table(s, d, "student_responses").select(selection.key_raw("question").alias("qkey"))
    return selection.open_pool(questions(s, d), used).select("row_idx", "qkey")


@query
def sample_ids(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("row_idx", selection.sample_id("question", "ground_truth").alias("sample_id"))


@query
def reference_kinds(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select(answers.reference_kind("ground_truth").alias("kind"), answers.big_number("ground_truth").alias("big"), answers.valid_reference("ground_truth").alias("valid"))
    return df.groupBy("kind", "big", "valid").agg(F.count("*").alias("n"))


@query
def length_tiers(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).groupBy(F.coalesce(selection.length_tier(F.col("answer")), F.lit("none")).alias("tier"), selection.accuracy_bin(F.col("acc")).alias("bin")).agg(F.count("*").alias("n"))


@query
def difficulty_buckets(s: SparkSession, d: str) -> DataFrame:
    acc = F.col("acc")
    status = F.when(F.col("row_idx") % 3 == 0, "both_correct").otherwise("none_correct")
    return questions(s, d).groupBy(selection.difficulty(acc).alias("plain"), selection.difficulty_rescue(acc, status).alias("rescue"), selection.start_bucket(acc).alias("start")).agg(F.count("*").alias("n"))


@query
def quota_top(s: SparkSession, d: str) -> DataFrame:
    df = docs(s, d).select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    return selection.top_of_groups(df, ["lang"], "doc_id", F.when(F.col("lang") == "en", 100).otherwise(25))


BUCKET_SHARES = {"sweet_spot": 0.55, "recoverable_hard": 0.20, "medium_easy": 0.15, "low_acc": 0.05, "unknown": 0.05}


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("question_id", selection.difficulty_rescue(F.col("acc"), F.lit(None).cast("string")).alias("bucket")).distinct()


@query
def bucket_quota(s: SparkSession, d: str) -> DataFrame:
    order = ["sweet_spot", "recoverable_hard", "medium_easy", "low_acc", "unknown", "fallback"]
    return selection.fill_by_quota(_bucketed(s, d), "bucket", "question_id", BUCKET_SHARES, 200, order)


@query
def balanced_classes(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select("question_id", selection.classify("question", selection.SUBJECTS_SHORT, {}).alias("subject"))
    return selection.balanced_by_class(df, "subject", "question_id", [*selection.SUBJECTS_SHORT, selection.OTHER])


@query
def capped_fill(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select(selection.key_strip("question").alias("qkey"), selection.classify("question").alias("subject"), selection.difficulty(F.col("acc")).alias("bucket"), answers.big_number("ground_truth").alias("is_big"))
    return selection.fill_with_cap(df, 200, selection.SUBJECT_SHARES, {"on_policy": 0.45, "mid_hard": 0.35, "hard_zero": 0.15, "unknown": 0.05})


@query
def selection_report(s: SparkSession, d: str) -> DataFrame:
    pool = questions(s, d).select(selection.classify("question").alias("subject")).groupBy("subject").agg(F.count("*").alias("pool"))
    got = capped_fill(s, d).groupBy("subject").agg(F.count("*").alias("actual"))
    return pool.join(got, "subject", "left").select("subject", "pool", F.coalesce("actual", F.lit(0)).alias("actual"), (selection.case_of(selection.SUBJECT_SHARES, "subject", 0.0) * 200).cast("int").alias("target"))


@query
def train_test_split(s: SparkSession, d: str) -> DataFrame:
    return selection.split_tail(questions(s, d).select("question_id").distinct(), "question_id", 80).select("question_id", "split")


@query
def ratio_split(s: SparkSession, d: str) -> DataFrame:
    return selection.split_ratio(questions(s, d).select("question_id").distinct(), "question_id", 0.8).select("question_id", "split")


@query
def shard_slices(s: SparkSession, d: str) -> DataFrame:
    return selection.shards(questions(s, d).select("row_idx"), 7)


@query
def batch_numbers(s: SparkSession, d: str) -> DataFrame:
    return selection.batches(questions(s, d).select("row_idx"), 64)


@query
def shuffled_rows(s: SparkSession, d: str) -> DataFrame:
    """All questions with their position in the shuffle."""
    return selection.shuffled_positions(questions(s, d).select("row_idx"), "row_idx", 42)


@query
def hash_shuffle(s: SparkSession, d: str) -> DataFrame:
    """A sample of 50 questions, the first of the shuffle."""
    return selection.shuffled(questions(s, d).select("row_idx"), "row_idx", 42).limit(50)


@query
def bernoulli_sample(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where(uniform(7, "doc_id") <= 0.3).select("doc_id")


@query
def tier_choice(s: SparkSession, d: str) -> DataFrame:
    """A prefix tier for each document by weights .50, .35, .15, and a ratio within it."""
    u, v = uniform("tier", "doc_id"), uniform("ratio", "doc_id")
    level = F.when(u < 0.5, "short").when(u < 0.85, "mid").otherwise("long")
    lo, hi = selection.case_of({"short": 0.15, "mid": 0.25, "long": 0.40}, "level", 0.0), selection.case_of({"short": 0.25, "mid": 0.40, "long": 0.55}, "level", 0.0)
    return docs(s, d).select("doc_id", level.alias("level"), v.alias("v")).select("doc_id", "level", F.round(lo + (hi - lo) * F.col("v"), 6).alias("ratio"))


# --- joins and sets ------------------------------------------------------------------------------------------


@query
def left_join_accuracy(s: SparkSession, d: str) -> DataFrame:
    acc = selection.last_per_key(table(s, d, "student_responses").select(selection.key_strip("question").alias("qkey"), "row_idx", (F.col("num_correct") / F.greatest(F.col("num_total"), F.lit(1))).alias("acc")), "qkey", "row_idx")
    q = table(s, d, "dpo_questions_24k_v2").select("row_idx", selection.key_strip("question").alias("qkey"))
    return q.join(acc.select("qkey", "acc"), "qkey", "left").select("row_idx", F.round("acc", 6).alias("acc"), selection.difficulty(F.col("acc")).alias("bucket"))


@query
def semi_join_targets(s: SparkSession, d: str) -> DataFrame:
    st = table(s, d, "student_responses").select("row_idx", selection.key_strip("question").alias("qkey"))
    q = table(s, d, "dpo_questions_24k_v2").select(selection.key_strip("question").alias("qkey"))
    return st.join(q, "qkey", "left_semi").select("row_idx")


@query
def anti_join_holdout(s: SparkSession, d: str) -> DataFrame:
    orders, items = table(s, d, "orders"), table(s, d, "lineitem")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").select("o_orderkey", "o_orderpriority")


@query
def inner_join_status(s: SparkSession, d: str) -> DataFrame:
    """Questions whose students all failed, with the status of the last generation of the question."""
    st = students(s, d).where("num_correct = 0").select(selection.key_raw("question").alias("qkey"))
    g = table(s, d, "warmstart_generations").select(selection.key_raw("question").alias("qkey"), "row_idx", "teacher_status")
    return st.join(selection.last_per_key(g, "qkey", "row_idx"), "qkey").select("qkey", "teacher_status")


@query
def positional_zip(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "dpo_questions_24k_v2").select("row_idx", "ground_truth")
    b = table(s, d, "warmstart_generations").select("row_idx", "predicted_answer")
    return a.join(b, "row_idx").select("row_idx", "ground_truth", "predicted_answer")


@query
def union_rounds(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "dpo_questions_24k_v2").select(selection.key_raw("question").alias("qkey"), F.lit(1).alias("round"))
    b = table(s, d, "student_responses").select(selection.key_raw("question").alias("qkey"), F.lit(2).alias("round"), "num_total")
    return a.unionByName(b, allowMissingColumns=True).groupBy("round").agg(F.count("*").alias("n"), F.count_distinct("qkey").alias("keys"), F.count("num_total").alias("counted"))


@query
def set_difference(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "dpo_questions_24k_v2").select(selection.key_raw("question").alias("qkey")).distinct()
    return a.join(table(s, d, "student_responses").select(selection.key_raw("question").alias("qkey")).distinct(), "qkey", "left_anti")


# --- responses and pairs -------------------------------------------------------------------------------------


@query
def pass_rates(s: SparkSession, d: str) -> DataFrame:
    c, n = F.col("num_correct"), F.col("num_total")
    return students(s, d).select("row_idx", "num_correct", "num_total", preference.pass_class(c, n).alias("kind"), preference.on_policy(c, n).alias("on_policy"), preference.on_policy(c, n, False).alias("mixed"), preference.needs_teacher(c, n).alias("needs_teacher"))


@query
def pass_distribution(s: SparkSession, d: str) -> DataFrame:
    return evaluation.shares(students(s, d).select(preference.pass_class(F.col("num_correct"), F.col("num_total")).alias("kind")), "kind")


@query
def wrong_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows whose stored count differs from the recount."""
    n = preference.pass_counts(F.col("responses"))["num_correct"]
    return table(s, d, "student_responses").select("row_idx", F.col("num_correct").alias("stored"), n.alias("counted")).where("stored <> counted")


@query
def teacher_statuses(s: SparkSession, d: str) -> DataFrame:
    r = lambda i: F.coalesce(F.get("responses", F.lit(i))["is_correct"], F.lit(False))
    return students(s, d).groupBy(preference.teacher_status(r(0), r(1)).alias("status")).agg(F.count("*").alias("n"))


@query
def greedy_pairs(s: SparkSession, d: str) -> DataFrame:
    return preference.greedy_pairs(students(s, d)).select("question", "chosen", "rejected")


@query
def simple_pairs(s: SparkSession, d: str) -> DataFrame:
    return preference.simple_pairs(students(s, d)).select("question", "chosen", "rejected")


@query
def mixed_pairs(s: SparkSession, d: str) -> DataFrame:
    st = students(s, d)
    good = table(s, d, "warmstart_generations").where("is_correct").select(selection.key_raw("question").alias("qkey"), "row_idx", F.col("full_response").alias("teacher_response"))
    rescued = preference.rescue_pairs(st.withColumn("qkey", selection.key_raw("question")), selection.last_per_key(good, "qkey", "row_idx"))
    return preference.mixed(preference.greedy_pairs(st), rescued, 100, "chosen")


@query
def pair_lengths(s: SparkSession, d: str) -> DataFrame:
    return preference.greedy_pairs(students(s, d)).agg(*evaluation.lengths(F.col("chosen"), F.col("rejected")))


@query
def preference_format(s: SparkSession, d: str) -> DataFrame:
    p = preference.greedy_pairs(students(s, d)).withColumn("prompt", preference.chat_prompt("question"))
    return preference.preference_rows(p).select(*(F.to_json(c).alias(c) if c != "system" else F.col(c) for c in ("conversations", "chosen", "rejected", "system")))


@query
def chat_prompts(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("row_idx", preference.chat_prompt("question").alias("prompt"), preference.question_of_prompt(preference.chat_prompt("question")).alias("back"))


@query
def benchmark_prompts(s: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(preference.STEP_PREFIX), "problem", F.lit(preference.STEP_SUFFIX))).otherwise(F.col("problem"))
    df = table(s, d, "eval_items").withColumn("p", p)
    return df.select("item_id", *(preference.benchmark_prompt("p", v).alias(v) for v in ("boxed", "steps", "none")))


@query
def few_shot_prompts(s: SparkSession, d: str) -> DataFrame:
    shots = [(r.problem, r.solution) for r in table(s, d, "eval_items").orderBy("item_id").limit(2).select("problem", "solution").collect()]
    return table(s, d, "eval_items").select("item_id", preference.few_shot_prompt("problem", shots).alias("prompt"))


@query
def chat_few_shot_prompts(s: SparkSession, d: str) -> DataFrame:
    """Eight solved items as turns of a chat before each item."""
    shots = [(r.problem, r.solution) for r in table(s, d, "eval_items").orderBy("item_id").limit(8).select("problem", "solution").collect()]
    return table(s, d, "eval_items").select("item_id", preference.chat_few_shot_prompt("problem", shots).alias("prompt"))


@query
def warm_start_format(s: SparkSession, d: str) -> DataFrame:
    return preference.warm_start_rows(generations(s, d)).select(F.to_json("conversations").alias("conversations"), "system")


@query
def rescored_teachers(s: SparkSession, d: str) -> DataFrame:
    """Teachers' responses judged anew where they were not correct."""
    df = generations(s, d).select("gen_id", "ground_truth", F.concat(F.lit("<think>"), "prefix", F.lit("</think>"), F.coalesce("continuation", F.lit(""))).alias("full_response"), F.col("predicted_answer").alias("predicted"), "is_correct", F.lit(None).cast("string").alias("response"))
    return preference.rescored_teachers(spread(df)).select("gen_id", "predicted", "is_correct", "response", "change")


def _rounds(s: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """Students' questions in two rounds by hash, with the right generations as teachers."""
    good = table(s, d, "warmstart_generations").where("is_correct").select(selection.key_raw("question").alias("qkey"), "row_idx", F.col("full_response").alias("teacher_response"))
    teachers = selection.last_per_key(good, "qkey", "row_idx")
    st = students(s, d).withColumn("_first", uniform("round", "row_idx") < 0.5)
    return [(st.where("_first").drop("_first"), teachers), (st.where("not _first").drop("_first"), teachers)]


@query
def assembled_rounds(s: SparkSession, d: str) -> DataFrame:
    """Pairs of two rounds of students and teachers, up to a target."""
    return preference.assembled_rounds(_rounds(s, d), 150).select("question", "chosen", "rejected", "source", "round")


@query
def training_rows(s: SparkSession, d: str) -> DataFrame:
    q = questions(s, d).withColumn("sample_id", selection.sample_id("question", "ground_truth"))
    return preference.training_rows(q, "math").select("data_source", "ability", *(F.to_json(c).alias(c) for c in ("prompt", "reward_model", "extra_info")))


@query
def conversations(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("row_idx", F.to_json(preference.conversation(F.col("question"), answers.with_box("answer"))).alias("conversations"))


# --- answers -------------------------------------------------------------------------------------------------


@query
def answers_flat(s: SparkSession, d: str) -> DataFrame:
    df = generations(s, d).select("gen_id", answers.flat_boxed("full_response").alias("pred"), "ground_truth")
    return df.select("gen_id", "pred", answers.close(answers.ratio_number("pred"), answers.ratio_number("ground_truth")).alias("correct"))


@query
def answers_simple(s: SparkSession, d: str) -> DataFrame:
    return generations(s, d).select("gen_id", answers.simple_extract("full_response").alias("simple"), answers.first_boxed("full_response").alias("first"), answers.stated_answer("full_response").alias("stated"))


@query
def answers_thinking(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("gen_id") % 2 == 0, F.concat(F.lit("<think>"), "prefix", F.lit("</think>"), F.coalesce("continuation", F.lit("")))).otherwise(F.concat("prefix", F.lit("</think>"), F.coalesce("continuation", F.lit(""))))
    df = generations(s, d).withColumn("t", t)
    return df.select("gen_id", answers.without_thinking("t").alias("bare"), answers.with_thinking("t").alias("marked"), answers.flat_boxed(answers.after_thinking("t")).alias("pred"))


@query
def marked_answers(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).withColumn("t", F.concat("answer", F.lit(" <<1+1=2>>\n#### "), "ground_truth"))
    return df.select("row_idx", answers.marked_answer("t").alias("gold"), answers.without_annotations("t").alias("text"))


def _family(name: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return spread(generations(s, d)).select("gen_id", answers.judged(name)(F.col("full_response"), F.col("ground_truth")).alias("v")).select("gen_id", "v.pred", "v.correct")

    run.__name__ = f"answers_{name}"
    query(run)


for _name in answers.JUDGES:
    _family(_name)


@query
def answers_final(s: SparkSession, d: str) -> DataFrame:
    return spread(generations(s, d)).select("gen_id", answers.correctness(F.col("full_response"), F.col("ground_truth")).alias("v")).select("gen_id", "v.*")


@query
def rescored(s: SparkSession, d: str) -> DataFrame:
    """Students' responses judged anew and counted again."""
    each = students(s, d).select("row_idx", "ground_truth", F.explode("responses").alias("r")).select("row_idx", answers.judged("nested")(F.col("r.text"), F.col("ground_truth")).alias("v"), "r.is_correct")
    return each.groupBy("row_idx").agg(F.count_if("v.correct").alias("num_correct"), F.count("*").alias("num_total"), F.count_if("is_correct").alias("stored"))


def _samples(s: SparkSession, d: str) -> DataFrame:
    """Marked-up samples of two questions each, the second with code for some."""
    one = F.concat(F.lit("**Question 1**: "), "question", F.lit("\n**Answer 1**:\n"), "answer", F.lit("\n"))
    two = F.concat(F.lit("**Question 2**: "), "question", F.lit("\n**Answer 2**:\n"), "answer", F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("\n**Code Implementation 2**:\nprint(x)\n# Output: "), "ground_truth")).otherwise(""))
    return questions(s, d).select(F.lit("questions").alias("source_file"), F.col("row_idx").alias("source_idx"), F.concat(one, two).alias("text"))


@query
def extracted_questions(s: SparkSession, d: str) -> DataFrame:
    return extract.extracted(_samples(s, d))


@query
def reference_sources(s: SparkSession, d: str) -> DataFrame:
    df = questions(s, d).select(answers.reference_from_solution("answer", F.lit("")).alias("g"))
    return df.groupBy("g.gt_source").agg(F.count("*").alias("n"), F.count("g.ground_truth").alias("found"))


@query
def sft_pairs(s: SparkSession, d: str) -> DataFrame:
    return extract.sft_pairs(_samples(s, d))


# --- prefixes, likeness, reward ------------------------------------------------------------------------------


@query
def tiered_prefixes(s: SparkSession, d: str) -> DataFrame:
    df = spread(questions(s, d)).select("row_idx", similarity.tiered_prefixes(F.col("answer"), F.col("ground_truth")).alias("p"))
    return df.where("p is not null").select("row_idx", "p.short", "p.mid", "p.long")


@query
def prefix_lengths(s: SparkSession, d: str) -> DataFrame:
    long = tiered_prefixes(s, d).unpivot("row_idx", ["short", "mid", "long"], "tier", "prefix")
    return long.groupBy("tier").agg(F.median(F.length("prefix")).alias("median"), F.round(F.avg(F.length("prefix")), 4).alias("mean"))


@query
def guided_prompts(s: SparkSession, d: str) -> DataFrame:
    u = uniform("guided", "row_idx")
    df = spread(questions(s, d)).withColumn("prefix", similarity.guided_prefix(F.col("answer"), F.col("ground_truth"), 0.15 + 0.4 * u)).where("prefix is not null")
    prompt = preference.messages(("system", F.lit(preference.SYSTEM)), ("user", F.col("question")), ("assistant", F.col("prefix")))
    return df.select("row_idx", F.to_json(prompt).alias("prompt"), F.length("prefix").alias("prefix_len"))


def _remainders(s: SparkSession, d: str) -> DataFrame:
    return spread(generations(s, d).where("continuation is not null and answer is not null")).withColumn("rest", F.substring("answer", F.length("prefix") + 1, F.length("answer")))


@query
def shared_runs(s: SparkSession, d: str) -> DataFrame:
    return _remainders(s, d).select("gen_id", similarity.shares_run("continuation", "rest").alias("copied"))


@query
def rouge_scores(s: SparkSession, d: str) -> DataFrame:
    return _remainders(s, d).select("gen_id", F.round(similarity.rouge(F.col("continuation"), F.col("rest")), 6).alias("rouge"))


def _warm(s: SparkSession, d: str) -> DataFrame:
    df = _remainders(s, d)
    reason = selection.cascade(("wrong", ~F.col("is_correct")), ("short", F.length("continuation") < 100), ("leak", F.contains(F.substring("continuation", 1, 50), strip("ground_truth"))))
    passed = df.withColumn("reason", reason).withColumn("copied", once(F.when(F.col("reason").isNull(), similarity.shares_run("continuation", "rest"))))
    passed = passed.withColumn("rouge", F.when(F.col("reason").isNull() & ~F.col("copied"), similarity.rouge(F.col("continuation"), F.col("rest"))))
    return passed.withColumn("reason", F.coalesce("reason", F.when(F.col("copied"), "copied").when(F.col("rouge") > 0.7, "alike")))


@query
def warmstart_cascade(s: SparkSession, d: str) -> DataFrame:
    return _warm(s, d).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


@query
def warmstart_best(s: SparkSession, d: str) -> DataFrame:
    """The best generation of each question, and a second of another prefix length that is unlike it."""
    rank = selection.case_of({"short": 0, "mid": 1, "long": 2}, "prefix_type", 9)
    good = written(_warm(s, d).where("reason is null").select(selection.key_raw("question").alias("qkey"), F.struct(rank.alias("rank"), "rouge", "gen_id", "prefix_type", "continuation").alias("g")), "warm")
    best = good.groupBy("qkey").agg(F.min("g").alias("g"))  # the least twice, not a sorted group
    rest = good.join(best.select(F.col("g.gen_id").alias("first_id")), F.col("g.gen_id") == F.col("first_id"), "left_anti").groupBy("qkey").agg(F.min("g").alias("g"))
    one = best.select("qkey", F.col("g.gen_id").alias("first_id"), F.col("g.prefix_type").alias("first_type"), F.col("g.continuation").alias("first_text"))
    two = rest.select("qkey", "g.gen_id", "g.prefix_type", "g.continuation")
    both = one.join(two, "qkey", "left").withColumn("likeness", similarity.rouge(F.col("first_text"), F.col("continuation")))
    second = F.when((F.col("prefix_type") != F.col("first_type")) & (F.col("likeness") < 0.5), F.col("gen_id"))
    return both.select("qkey", "first_id", second.alias("second_id"))


@query
def line_penalties(s: SparkSession, d: str) -> DataFrame:
    return generations(s, d).where("continuation is not null").select("gen_id", F.round(reward.line_penalty("continuation"), 6).alias("penalty"))


@query
def rewards(s: SparkSession, d: str) -> DataFrame:
    df = spread(generations(s, d)).withColumn("quality", let(features.feature_struct("full_response"), features.score))
    return df.select("gen_id", reward.reward("full_response", "ground_truth", F.col("quality")).alias("r")).select("gen_id", "r.acc", "r.near_correct", "r.has_boxed", F.round("r.score", 6).alias("score"), F.round("r.repetition_penalty", 6).alias("penalty"))


@query
def prefix_type_accuracy(s: SparkSession, d: str) -> DataFrame:
    return generations(s, d).groupBy("prefix_type").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("n_correct"), F.count_distinct(F.when(F.col("is_correct"), selection.key_raw("question"))).alias("solved"))


@query
def solve_rates(s: SparkSession, d: str) -> DataFrame:
    df = generations(s, d).select(selection.key_raw("question").alias("qkey"), F.coalesce("is_correct", F.lit(False)).alias("ok"))
    return evaluation.solve_rate(df, "qkey", "ok")


# --- evaluation ----------------------------------------------------------------------------------------------


@query
def accuracy_sets(s: SparkSession, d: str) -> DataFrame:
    df = generations(s, d).select("prefix_type", "teacher_status", F.coalesce("is_correct", F.lit(False)).alias("correct"))
    return evaluation.accuracy(df, "prefix_type", "teacher_status")


@query
def accuracy_delta(s: SparkSession, d: str) -> DataFrame:
    df = generations(s, d).select("teacher_status", "prefix_type", F.coalesce("is_correct", F.lit(False)).cast("int").alias("ok"))
    part = lambda t: df.where(F.col("prefix_type") == t).groupBy("teacher_status").agg(F.avg("ok").alias("accuracy"))
    return evaluation.deltas(part("short"), part("long"), "teacher_status")


@query
def wrong_examples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "warmstart_generations").where("not is_correct").orderBy("row_idx").limit(5).select("row_idx", "predicted_answer", "ground_truth")


@query
def source_shares(s: SparkSession, d: str) -> DataFrame:
    return evaluation.shares(docs(s, d).select(F.coalesce("source", F.lit("none")).alias("source")), "source")


@query
def prompt_softmax(s: SparkSession, d: str) -> DataFrame:
    """Weights of a question's generations by their rewards."""
    df = generations(s, d).select("gen_id", selection.key_raw("question").alias("qkey"), F.coalesce("is_correct", F.lit(False)).cast("double").alias("r"))
    return evaluation.softmax_shares(df, "qkey", "r", 0.5).select("gen_id", F.round("weight", 6).alias("weight"))


# --- learning progress ---------------------------------------------------------------------------------------


def observations(s: SparkSession, d: str) -> DataFrame:
    """Observations once each: a repeated row is the same in all but its number and time."""
    return table(s, d, "lp_observations").select("sample_id", "step", "reward", "is_pg")


def _states(s: SparkSession, d: str) -> DataFrame:
    return progress.updated(progress.step_rates(observations(s, d)))


@query
def lp_rates(s: SparkSession, d: str) -> DataFrame:
    return progress.step_rates(observations(s, d)).select("sample_id", "is_pg", "step", F.round("rate", 6).alias("rate"))


@query
def lp_states(s: SparkSession, d: str) -> DataFrame:
    return _states(s, d).select("sample_id", F.round("p", 6).alias("p"), F.round("lp", 6).alias("lp"), "n_updates", F.round("pg_p_ema", 6).alias("pg_p_ema"), "pg_seen")


@query
def lp_initial(s: SparkSession, d: str) -> DataFrame:
    st = table(s, d, "student_responses").withColumn("sample_id", selection.sample_id("question", "ground_truth"))
    return progress.initial(st).select("sample_id", F.round("p", 6).alias("p"), "lp", "n_updates")


@query
def lp_continued(s: SparkSession, d: str) -> DataFrame:
    """States begun from the students' pass rates and moved on by the observations."""
    start = lp_initial(s, d).withColumn("pg_p_ema", F.lit(None).cast("double")).withColumn("pg_seen", F.lit(None).cast("int"))
    out = progress.updated(progress.step_rates(observations(s, d)), start)
    return out.select("sample_id", F.round("p", 6).alias("p"), "n_updates")


@query
def lp_weights(s: SparkSession, d: str) -> DataFrame:
    p, lp = F.col("p"), F.col("lp")
    return _states(s, d).select("sample_id", F.round(progress.weight(lp), 6).alias("weight"), F.round(progress.documented_weight(p, lp), 6).alias("documented"))


@query
def lp_summary(s: SparkSession, d: str) -> DataFrame:
    return progress.summary(_states(s, d)).select("n", F.round("avg_p", 6).alias("avg_p"), F.round("avg_lp", 6).alias("avg_lp"), "n_hard", "n_sweet", "n_mastered", F.round("avg_weight", 6).alias("avg_weight"))


@query
def lp_categories(s: SparkSession, d: str) -> DataFrame:
    return progress.categories(_states(s, d)).groupBy("category").agg(F.count("*").alias("n"))


@query
def lp_guided(s: SparkSession, d: str) -> DataFrame:
    return progress.guided_candidates(_states(s, d)).select("sample_id", "n_updates")


def _early(s: SparkSession, d: str) -> DataFrame:
    """States after each sample's second step, when guidance is first asked for."""
    return progress.updated(progress.first_steps(progress.step_rates(observations(s, d)), 2))


@query
def lp_guided_early(s: SparkSession, d: str) -> DataFrame:
    return progress.guided_candidates(_early(s, d)).select("sample_id", "n_updates")


def _rollouts(s: SparkSession, d: str) -> DataFrame:
    """States after two rollouts of the students: their first four responses, and the next ones."""
    each = students(s, d).select(selection.sample_id("question", "ground_truth").alias("sample_id"), F.posexplode("responses").alias("at", "r"))
    seen = each.select("sample_id", F.when(F.col("at") < 4, 0).otherwise(1).cast("long").alias("step"), F.coalesce("r.is_correct", F.lit(False)).cast("double").alias("reward"), F.lit(False).alias("is_pg"))
    return progress.updated(progress.step_rates(seen))


@query
def lp_guided_students(s: SparkSession, d: str) -> DataFrame:
    """Samples that are stuck after two rollouts of the students."""
    return progress.guided_candidates(_rollouts(s, d)).select("sample_id", "n_updates")


@query
def lp_guided_rows(s: SparkSession, d: str) -> DataFrame:
    """Guided prompts for the samples that are stuck after two rollouts of the students."""
    q = questions(s, d).withColumn("sample_id", selection.sample_id("question", "ground_truth"))
    return progress.guided_rows(progress.guided_candidates(_rollouts(s, d)), q, 100).withColumn("prompt", F.to_json("prompt"))


@query
def lp_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Configuration and summary of a snapshot of the states, and how many states come back from it."""
    folder = shared_folder(s, "lp_snapshot")
    progress.save_states(_states(s, d), f"{folder}/lp")
    told = s.read.json(f"{folder}/lp/about").select("config.*", F.round("summary.avg_p", 6).alias("avg_p"), F.round("summary.avg_weight", 6).alias("avg_weight"), "summary.n")
    return told.withColumn("loaded", F.lit(progress.load_states(s, f"{folder}/lp").count()))


@query
def teacher_messages(s: SparkSession, d: str) -> DataFrame:
    """Prompts for a teacher that is told the answer."""
    told = F.concat("question", F.lit("\n\nThe correct answer is "), "ground_truth", F.lit("."))
    return questions(s, d).select("row_idx", F.to_json(preference.messages(("system", F.lit(preference.SYSTEM)), ("user", told))).alias("messages"))


@query
def lp_advantages(s: SparkSession, d: str) -> DataFrame:
    t = observations(s, d).select("sample_id", "step", F.array(F.coalesce("reward", F.lit(0.0)), F.lit(1.0)).alias("advantages"))
    out = progress.weighted_advantages(t, _states(s, d))
    return out.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum(F.get("advantages", F.lit(1))), 4).alias("total"))


@query
def lp_cycle(s: SparkSession, d: str) -> DataFrame:
    rows = questions(s, d).select(selection.sample_id("question", "ground_truth").alias("sample_id"))
    return progress.cycle(rows, _states(s, d), {"sweet_spot": 0.45, "learning": 0.25, "struggling": 0.10, "mastered": 0.05, "exploration": 0.05}, 200)


@query
def lp_stream(s: SparkSession, d: str) -> DataFrame:
    """The same states kept by a stream over the observations in batches, run until all files are read."""
    from tessera.streaming.progress import latest, run_available

    path = f"{d}/lp_observations.parquet"
    shape = s.read.parquet(path).schema
    folder = shared_folder(s, "lp_stream")
    run_available(s.readStream.schema(shape).option("maxFilesPerTrigger", 8).parquet(f"{path}*"), f"{folder}/out", f"{folder}/checkpoint")
    return latest(s.read.parquet(f"{folder}/out")).select("sample_id", F.round("p", 6).alias("p"), F.round("lp", 6).alias("lp"), "n_updates")


# --- tokens --------------------------------------------------------------------------------------------------


#: Length of a sequence, prompt and response, as the reference's trainer sets it.
SEQUENCE = 16384


def _ids(c: Column) -> Column:
    """Made-up token numbers of a text: its letters' places in the alphabet."""
    return F.transform(F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), ""), lambda x: F.ascii(x))


@query
def padded_sequences(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "eval_items").select("item_id", tokens.padded(_ids(F.col("problem")), _ids(F.col("solution")), SEQUENCE, 0).alias("b"))
    return df.where("b is not null").select("item_id", *(F.to_json(f"b.{c}").alias(c) for c in ("input_ids", "attention_mask", "position_ids", "loss_mask")))


@query
def paired_sequences(s: SparkSession, d: str) -> DataFrame:
    """Teacher's and student's sequences of each item: the teacher is told the level, every third token is a tool's."""
    ids = table(s, d, "eval_items").select("item_id", "type", _ids(F.col("problem")).alias("prompt_ids"), _ids(F.concat_ws(" ", "problem", "level")).alias("told_ids"), _ids(F.col("solution")).alias("r"))
    padding = F.array_repeat(F.lit(0), 4)
    df = ids.select("item_id", "type", "prompt_ids", "told_ids", F.concat("r", padding).alias("response_ids"), F.concat(F.transform("r", lambda _: F.lit(1)), padding).alias("attention"), F.concat(F.transform("r", lambda _, i: (i % 3 != 2).cast("int")), padding).alias("mask"))
    out = tokens.paired_batch(df, 512, 0, "prompt_ids", "told_ids", "mask", ["item_id", "type"])
    lists = [c for c in out.columns if c.startswith(("teacher_", "student_"))]
    return out.select("item_id", "type", "valid_row_mask", *(F.to_json(F.transform(c, lambda x: x.cast("int"))).alias(c) for c in lists))


def _logits(s: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", e.alias("student"), F.reverse(e).alias("teacher"))


@query
def token_divergences(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("student"), F.col("teacher")
    return _logits(s, d).select("vec_id", F.round(tokens.reverse_kl(a, b), 6).alias("reverse_kl"), F.round(tokens.forward_kl(a, b), 6).alias("forward_kl"), F.round(tokens.entropy(a), 6).alias("entropy"), F.round(tokens.probability(b, F.lit(0)), 6).alias("p_first"))


@query
def token_weights(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("student"), F.col("teacher")
    df = _logits(s, d).select("vec_id", tokens.normal_entropy(a).alias("ent"), tokens.normal_divergence(a, b).alias("div"), tokens.normal_divergence(a, b, 4).alias("div4"))
    return df.select("vec_id", F.round("ent", 6).alias("ent"), F.round("div", 6).alias("div"), F.round("div4", 6).alias("div4"), F.round(tokens.token_weight(F.col("ent"), F.col("div"), 1.0, 0.5), 6).alias("weight"))


@query
def token_samples(s: SparkSession, d: str) -> DataFrame:
    """Half of the tokens of each sequence drawn by weight; 32 neighbouring vectors stand for a sequence's tokens."""
    a, b = F.col("student"), F.col("teacher")
    weight = tokens.token_weight(tokens.normal_entropy(a), tokens.normal_divergence(a, b), 1.0, 0.5)
    each = _logits(s, d).select(F.floor(F.col("vec_id") / 32).alias("sequence"), "vec_id", weight.alias("weight"))
    rows = each.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("vec_id", "weight"))).alias("tokens"))
    drawn = rows.withColumn("token", F.explode(tokens.sampled(F.col("tokens.weight"), 0.5, 0, "sequence")))
    return drawn.select("sequence", F.size("tokens").alias("n_total"), "token", F.get("tokens", F.col("token"))["vec_id"].alias("vec_id"))


# --- files ---------------------------------------------------------------------------------------------------


@query
def parquet_row_ids(s: SparkSession, d: str) -> DataFrame:
    return files.read_parquet_rows(s, f"{d}/eval_items.parquet").select("id", "item_id")
