"""Preference pairs, prompts and training formats out of scored responses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.answers import judged, without_thinking
from tessera.functions.pytext import col, hash_order, strip
from tessera.operators.models import rounds_done
from tessera.sources.tables import written

# The prompts' texts.
SYSTEM = "Please reason step by step, and put your final answer within \\boxed{}."
STEP_PREFIX = "Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n"
STEP_SUFFIX = '\n\nRemember to put your answer on its own line after "Answer:".'
BOXED = "Let's think step by step and output the final answer within \\boxed{}."


def pass_counts(responses: Column) -> Column:
    """(num_correct, num_total) of an array of responses with is_correct; null verdicts count as wrong."""
    return F.struct(F.size(F.filter(responses, lambda r: r["is_correct"])).alias("num_correct"), F.size(responses).alias("num_total"))


def pass_class(correct: Column, total: Column) -> Column:
    """all, half and above, below half, or zero."""
    return F.when(correct == total, "all").when(correct >= F.floor(total / 2), "half").when(correct > 0, "below").otherwise("zero")


def on_policy(correct: Column, total: Column, strict: bool = True) -> Column:
    """Some wrong and, if ``strict``, at least half (rounded down) right, else at least one."""
    return (correct < total) & ((correct >= F.floor(total / 2)) if strict else (correct > 0))


def needs_teacher(correct: Column, total: Column) -> Column:
    return correct < F.floor(total / 2)


def teacher_status(first: Column, second: Column) -> Column:
    return F.when(first & second, "both_correct").when(first | second, "one_correct").otherwise("none_correct")


def length_ratio_ok(a: Column, b: Column, most: float = 2.5) -> Column:
    x, y = F.length(a), F.length(b)
    return (x > 0) & (y > 0) & (F.try_divide(F.greatest(x, y), F.least(x, y)) <= most)


def best_matches(chosen: Column, rejected: Column, most: float = 2.5) -> Column:
    """Up to two disjoint pairs of texts whose lengths differ least, ties by position; arrays of strings in, structs out.

    The best pair is the least (difference, i, j); the second is the least that shares neither side. Pairs of
    one question stay inside its row, so there is no join.
    """
    zipped = lambda a: F.transform(a, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i")))
    pairs = F.flatten(F.transform(zipped(chosen), lambda c: F.transform(zipped(rejected), lambda r: F.struct(F.abs(c["n"] - r["n"]).alias("d"), c["i"].alias("ci"), r["i"].alias("ri"), (F.greatest(c["n"], r["n"]) / F.greatest(F.least(c["n"], r["n"]), F.lit(1)) <= most).alias("ok")))))
    fit = F.filter(pairs, lambda p: p["ok"])
    one = F.array_min(fit)
    two = F.array_min(F.filter(fit, lambda p: (p["ci"] != one["ci"]) & (p["ri"] != one["ri"])))
    text = lambda p: F.when(p.isNotNull(), F.struct(F.get(chosen, p["ci"]).alias("chosen"), F.get(rejected, p["ri"]).alias("rejected")))
    return F.array_compact(F.array(text(one), text(two)))


def texts(responses: Column, right: bool) -> Column:
    kept = F.filter(responses, lambda r: F.coalesce(r["is_correct"], F.lit(False)) == F.lit(right))
    return F.transform(kept, lambda r: r["text"])


def greedy_pairs(students: DataFrame) -> DataFrame:
    """(question, ground_truth, chosen, rejected, source) from students (question, ground_truth, num_correct, num_total, responses)."""
    df = students.where(on_policy(F.col("num_correct"), F.col("num_total")))
    pairs = best_matches(texts(F.col("responses"), True), texts(F.col("responses"), False))
    return df.select("question", "ground_truth", F.explode(pairs).alias("p")).select("question", "ground_truth", "p.chosen", "p.rejected", F.lit("on_policy").alias("source"))


def shuffled_texts(items: Column, seed: str) -> Column:
    """An array of texts in the order of their hashes."""
    return F.transform(F.array_sort(F.transform(items, lambda x, i: F.struct(F.sha1(F.concat(F.lit(seed), i.cast("string"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])


def simple_pairs(students: DataFrame, seed: str = "0") -> DataFrame:
    """Two pairs where both sides have two responses, else one, from questions with right and wrong ones."""
    df = students.where(on_policy(F.col("num_correct"), F.col("num_total"), strict=False))
    good, bad = shuffled_texts(texts(F.col("responses"), True), seed), shuffled_texts(texts(F.col("responses"), False), seed)
    n = F.when((F.size(good) >= 2) & (F.size(bad) >= 2), 2).otherwise(F.least(F.lit(1), F.size(good), F.size(bad)))
    both = F.arrays_zip(F.slice(good, F.lit(1), n).alias("chosen"), F.slice(bad, F.lit(1), n).alias("rejected"))
    return df.select("question", "ground_truth", F.explode(both).alias("p")).select("question", "ground_truth", "p.chosen", "p.rejected", F.lit("on_policy").alias("source"))


def rescue_pairs(students: DataFrame, teachers: DataFrame, seed: str = "0") -> DataFrame:
    """Teacher's text against a wrong answer chosen by hash, for questions below half; teachers (qkey, teacher_response), the length ratio bounded."""
    df = students.where(needs_teacher(F.col("num_correct"), F.col("num_total"))).join(teachers.select("qkey", "teacher_response"), "qkey")
    wrong = F.get(shuffled_texts(texts(F.col("responses"), False), seed), F.lit(0))
    out = df.select("question", "ground_truth", F.col("teacher_response").alias("chosen"), wrong.alias("rejected"), F.lit("teacher").alias("source"))
    return out.where(length_ratio_ok(F.col("chosen"), F.col("rejected")))


def mixed(first: DataFrame, second: DataFrame, total: int, key: str, seed: int | str = 0) -> DataFrame:
    """``total`` rows: all of the first source, then of the second, each in hash order."""
    from tessera.operators.selection import prefix_cut

    both = first.withColumn("_p", F.lit("000")).unionByName(second.withColumn("_p", F.lit("001"))).withColumn("_code", F.concat("_p", hash_order(seed, key)))
    stop = prefix_cut(both, "_code", total)
    return (both if stop is None else both.where(F.col("_code") <= stop)).drop("_p", "_code")


def chat_prompt(question: Column | str, system: str = SYSTEM) -> Column:
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), col(question), F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def question_of_prompt(prompt: Column | str) -> Column:
    found = F.regexp_extract(col(prompt), r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>", 1)
    return F.when(found != "", strip(found)).otherwise(col(prompt))


def messages(*parts: tuple[str, Column]) -> Column:
    """Chat messages as an array of (role, content)."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in parts))


def benchmark_prompt(question: Column | str, variant: str = "boxed") -> Column:
    """A benchmark's question without the step instruction, with that of the variant: boxed, steps or none."""
    q = col(question)
    q = F.when(F.startswith(q, F.lit(STEP_PREFIX)), F.substring(q, F.lit(len(STEP_PREFIX) + 1), F.length(q))).otherwise(q)
    q = F.when(F.endswith(q, F.lit(STEP_SUFFIX)), F.substring(q, F.lit(1), F.length(q) - len(STEP_SUFFIX))).otherwise(q)
    q = F.regexp_replace(q, r"(?U)\s+$", "")
    if variant == "steps":
        return F.concat(F.lit(STEP_PREFIX), q, F.lit(STEP_SUFFIX))
    return F.concat(q, F.lit("\n\n" + BOXED)) if variant == "boxed" else q


def few_shot_prompt(question: Column | str, shots: list[tuple[str, str]]) -> Column:
    head = "".join(f"Question: {q}\nAnswer: {a}\n\n" for q, a in shots)
    return F.concat(F.lit(head + "Question: "), col(question), F.lit("\nAnswer:"))


def chat_few_shot_prompt(question: Column | str, shots: list[tuple[str, str]], system: str = SYSTEM, user_prefix: str = "") -> Column:
    """A chat in which each shot is a turn of its own before the question; texts are stripped, annotations of shots dropped."""
    turn = lambda who, x: f"<|im_start|>{who}\n{x}<|im_end|>\n"
    bare = lambda x: re.sub("<<[^>]+>>", "", x.strip())
    head = turn("system", system) + "".join(turn("user", user_prefix + q.strip()) + turn("assistant", bare(a)) for q, a in shots)
    return F.concat(F.lit(f"{head}<|im_start|>user\n{user_prefix}"), strip(question), F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def conversation(question: Column, answer: Column) -> Column:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return F.array(turn("human", question), turn("gpt", answer))


def preference_rows(pairs: DataFrame, most_chars: int | None = None) -> DataFrame:
    """(conversations, chosen, rejected, system) of pairs (prompt, chosen, rejected), texts cut to ``most_chars``."""
    cut = lambda c: F.col(c) if most_chars is None else F.substring(c, 1, most_chars)
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    return pairs.select(F.array(turn("human", question_of_prompt("prompt"))).alias("conversations"), turn("gpt", cut("chosen")).alias("chosen"), turn("gpt", cut("rejected")).alias("rejected"), F.lit(SYSTEM).alias("system"))


def warm_start_rows(generations: DataFrame) -> DataFrame:
    """(conversations, system) of generations (question, full_response): the whole response, prefix and continuation."""
    return generations.select(conversation(F.col("question"), F.col("full_response")).alias("conversations"), F.lit(SYSTEM).alias("system"))


def rescored_teachers(teachers: DataFrame, family: str = "nested") -> DataFrame:
    """Teachers (full_response, ground_truth, predicted, is_correct, response) judged anew where they were not correct.

    Rows that were correct stay as they are. Of the others those that are correct now get the new answer and the
    response without its thoughts; the rest keep theirs. ``change`` tells kept, rescued or wrong.
    """
    was = F.coalesce("is_correct", F.lit(False))
    df = teachers.withColumn("_v", judged(family)(F.when(~was, F.col("full_response")), F.col("ground_truth")))
    now = ~was & F.coalesce(F.col("_v.correct"), F.lit(False))
    bare = without_thinking("full_response", fallbacks=False)
    df = df.withColumn("change", F.when(was, "kept").when(now, "rescued").otherwise("wrong")).withColumn("predicted", F.when(now, F.col("_v.pred")).otherwise(F.col("predicted")))
    df = df.withColumn("response", F.when(now, F.when(bare != "", bare).otherwise(F.col("full_response"))).otherwise(F.col("response")))
    return df.withColumn("is_correct", was | now).drop("_v")


def round_pairs(students: DataFrame, teachers: DataFrame, number: int, seed: str = "0") -> DataFrame:
    """(question, ground_truth, chosen, rejected, source, round) of one round's students and right teachers (qkey, teacher_response).

    Questions with at least half right give one or two pairs of their own; those with none right the teacher's
    text against a wrong answer; the others none.
    """
    own = simple_pairs(students.where(on_policy(F.col("num_correct"), F.col("num_total"))), f"{seed}/{number}")
    wrong = F.get(shuffled_texts(texts(F.col("responses"), False), f"{seed}/{number}"), F.lit(0))
    failed = students.where("num_correct = 0 and num_correct < num_total").withColumn("qkey", F.substring("question", 1, 120)).where(~on_policy(F.col("num_correct"), F.col("num_total")))
    rescued = failed.join(teachers.select("qkey", "teacher_response"), "qkey").select("question", "ground_truth", F.col("teacher_response").alias("chosen"), wrong.alias("rejected"), F.lit("teacher_chosen").alias("source"))
    return own.unionByName(rescued).withColumn("round", F.lit(number))


def assembled_rounds(rounds: list[tuple[DataFrame, DataFrame]], target: int, seed: int = 42) -> DataFrame:
    """At most ``target`` pairs of all rounds (students, teachers): on-policy pairs first, then teachers', each at random.

    All rounds are one plan; nothing is collected between them but the counts of order prefixes.
    """
    parts = [round_pairs(s, t, i + 1, str(seed)) for i, (s, t) in enumerate(rounds)]
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    pairs = written(pairs, "rounds")
    own = F.col("source") == "on_policy"
    return mixed(pairs.where(own), pairs.where(~own), target, "chosen", seed)


def iterated(step: Callable[[int], DataFrame], target: int, most_rounds: int, share: float = 0.9) -> list[DataFrame]:
    """Pairs of round after round, ``step(number)``, until there are ``share`` of ``target`` or ``most_rounds`` are done."""
    done: list[DataFrame] = []
    total = 0
    while len(done) < most_rounds and not rounds_done(total, target, share):
        done.append(written(step(len(done) + 1), "round"))
        total += done[-1].count()
    return done


def training_rows(questions: DataFrame, data_source: str) -> DataFrame:
    """Reinforcement rows (data_source, prompt, ability, reward_model, extra_info) of questions (question, ground_truth, sample_id, category, acc, row_idx)."""
    info = F.struct("sample_id", "category", F.col("acc").alias("student_accuracy"), F.lit(False).alias("is_pg_sample"), F.col("row_idx").cast("long").alias("index"))
    return questions.select(F.lit(data_source).alias("data_source"), messages(("system", F.lit(SYSTEM)), ("user", F.col("question"))).alias("prompt"), F.lit("math").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("ground_truth")).alias("reward_model"), info.alias("extra_info"))
