"""Selection, pairs, progress, files and streams: brute force, invariants and edge cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cleaner, extract, preference, progress, selection
from tessera.sources import files


def test_quota_cuts_equal_sorting(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string").withColumn("h", F.sha1(F.concat(F.lit("0|"), F.col("id").cast("string"))))
    got = {r.id for r in selection.top_of_groups(df.drop("h"), ["g"], "id", F.when(F.col("g") == "hot", 500).otherwise(9)).collect()}
    by: dict = {}
    for r in df.collect():
        by.setdefault(r.g, []).append((r.h, r.id))
    assert got == {i for g, v in by.items() for _, i in sorted(v)[: 500 if g == "hot" else 9]}


def test_numbering_is_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 1009,) for i in range(1009)], "k int")
    out = selection.numbered(df, "k").collect()
    assert all(r.k == r._n for r in out) and len(out) == 1009
    sizes = [r["count"] for r in selection.shards(df, 4, "k").groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [253, 252, 252, 252]


def test_wide_rows_are_all_numbered(spark):
    """Rows so wide that counting and reading them would be coalesced into different partitions."""
    n = 120_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("row_idx"), F.concat_ws("-", F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("wide"), F.lit(1).alias("_part"))
        out = selection.numbered(df.drop("_part"), "row_idx")
        told = out.agg(F.count("*").alias("n"), F.count_if(F.col("_n") == F.col("row_idx")).alias("right"), F.count_distinct("wide").alias("wide")).first()
        assert tuple(told) == (n, n, n)
        assert [(r.shard, r["count"]) for r in selection.shards(df.drop("_part"), 7).groupBy("shard").count().orderBy("shard").collect()] == [(i, n // 7 + (i < n % 7)) for i in range(7)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_of_each_key_both_ways(spark):
    rng = random.Random(11)
    rows = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 300)}", f"t{i}", "clash") for i in range(1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "at int, k string, text string, _least string")
    want: dict = {}
    for r in sorted(rows):
        want.setdefault(r[1], r)
    for wide in (1 << 40, 0):
        assert sorted(map(tuple, selection.first_per_key(df, F.col("k"), "at", wide).collect())) == sorted((r[0], *r[1:]) for r in want.values())
        assert selection.first_per_key(df.where("false"), F.col("k"), "at", wide).count() == 0


def test_numbering_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (3,), (3,), (1,)], "k int")
    assert sorted(r._n for r in selection.numbered(df, "k").collect()) == [0, 1, 2, 3]
    assert selection.numbered(df.where("false"), "k").count() == 0


def test_capped_fill_keeps_its_promises(spark):
    rng = random.Random(6)
    rows = [(f"q{i}", rng.choice(["代数/函数", "几何", "数论"]), rng.choice(["on_policy", "mid_hard"]), rng.random() < 0.5) for i in range(900)]
    df = spark.createDataFrame(rows, "qkey string, subject string, bucket string, is_big boolean")
    out = selection.fill_with_cap(df, 300, {"代数/函数": 0.5, "几何": 0.5}, {"on_policy": 0.6, "mid_hard": 0.4}, strict_cap=True).collect()
    assert len({r.qkey for r in out}) == len(out) <= 300 and sum(r.is_big for r in out) <= 15
    again = selection.fill_with_cap(df.repartition(7), 300, {"代数/函数": 0.5, "几何": 0.5}, {"on_policy": 0.6, "mid_hard": 0.4}, strict_cap=True).collect()
    assert sorted(out) == sorted(again)


def test_quotas_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, g string")
    assert selection.top_of_groups(empty, ["g"], "id", F.lit(3)).count() == 0
    assert selection.fill_by_quota(empty, "g", "id", {"a": 1.0}, 5, ["a"]).count() == 0
    assert selection.split_tail(empty, "id", 2).count() == 0


def test_classes_match_anywhere(spark):
    df = spark.createDataFrame([("a spring",), ("the force",), ("x",), (None,)], "q string").select(selection.classify("q").alias("c"))
    assert [r.c for r in df.collect()] == ["抽象代数", "物理", selection.OTHER, selection.OTHER]


def test_best_matches_by_brute_force(spark):
    rng = random.Random(7)
    cases = [([("x" * rng.randint(1, 9)) for _ in range(rng.randint(0, 4))], [("y" * rng.randint(1, 9)) for _ in range(rng.randint(0, 4))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>").select("i", preference.best_matches(F.col("a"), F.col("b")).alias("p"))
    got = {r.i: [(p.chosen, p.rejected) for p in r.p] if r.p else [] for r in df.collect()}
    for i, (a, b) in enumerate(cases):
        pairs, used = [], set()
        for _, x, y in sorted((abs(len(c) - len(r)), x, y) for x, c in enumerate(a) for y, r in enumerate(b) if max(len(c), len(r)) / max(1, min(len(c), len(r))) <= 2.5):
            if len(pairs) < 2 and ("c", x) not in used and ("r", y) not in used:
                pairs.append((a[x], b[y]))
                used |= {("c", x), ("r", y)}
        assert got[i] == pairs


def test_progress_of_two_steps(spark):
    obs = spark.createDataFrame([("a", 1, 0.0, False), ("a", 2, 1.0, False), ("a", 2, 0.0, None), ("a", 2, None, False), ("a", 2, -1.0, False), ("b", 5, 1.0, True), (None, 1, 1.0, False)], "sample_id string, step bigint, reward double, is_pg boolean")
    out = {r.sample_id: r for r in progress.updated(progress.step_rates(obs)).collect()}
    assert (out["a"].p, out["a"].lp, out["a"].n_updates) == pytest.approx((0.05, 0.05, 2))
    assert (out["b"].p, out["b"].n_updates, out["b"].pg_p_ema, out["b"].pg_seen) == (0.0, 0, 1.0, 1)
    w = spark.createDataFrame([(0.05,), (0.0,), (-0.05,), (None,)], "lp double").select(F.round(progress.weight(F.col("lp")), 4).alias("w"))
    assert [r.w for r in w.collect()] == [1.0987, 1.0, 0.9013, 1.0]


def test_categories_at_their_bounds(spark):
    df = spark.createDataFrame([(0.05, 0.1), (0.1, 0.1), (0.15, 0.1), (0.5, 0.0), (0.8, 0.1), (0.81, 0.1), (0.0, 0.1)], "p double, lp double").select(progress.labels(F.col("p"), F.col("lp")).alias("l"))
    assert [r.l for r in df.collect()] == [["struggling"], ["struggling"], ["sweet_spot", "learning"], ["sweet_spot"], ["learning"], ["mastered"], ["hard_zero"]]


def test_sections_and_pairs():
    text = "**Question 2**: b?\n**Answer 2**:\nbb\n**Question 1**: a?\n**Answer 1**:\naa\n**Code Implementation 1**:\nprint(1)"
    assert extract.sections(text) == [(1, "a?", "aa", "print(1)"), (2, "b?", "bb", "")]
    assert extract.qa_pairs(text) == [("b?", "bb"), ("a?", "aa")]
    assert extract.sections("") == extract.qa_pairs("") == []


def test_cleaner_routes_and_resumes(spark):
    good = "Theorem. We prove that \\frac{a}{b} + \\sqrt{c} = \\int x dx. Proof: solution. " * 4
    docs = spark.createDataFrame([("d1", good), ("d2", "hi"), ("d3", " "), ("d4", None), (None, good)], "id string, text string")
    df = cleaner.clean_documents(docs)
    audit = {r.id: r for r in cleaner.audit(df).collect()}
    assert audit["d1_seg_0000"].route == "kept_light_cleaned" and audit["d2_seg_0000"].fail_reasons == ["hard_drop_by_rule"] and len(audit) == 2
    s = cleaner.summary(cleaner.audit(df)).first()
    assert (s.total_segments, s.direct_kept, s.rule_dropped, s.final_kept, s.final_dropped) == (2, 1, 1, 1, 1)
    assert sorted(r.id or "" for r in cleaner.resume(docs, cleaner.audit(df)).collect()) == ["", "d3", "d4"]


def test_model_failures_fall_back(spark):
    text = "Let x = 1 + 2 - 3 * 4. " * 3
    docs = spark.createDataFrame([("d", text)], "id string, text string")
    broken = lambda c: (c, F.lit("keep_as_is"), F.lit("boom"))
    r = cleaner.audit(cleaner.clean_documents(docs, broken)).first()
    assert r.llm_decision == "error" and r.fail_reasons == ["llm_error: boom"] and r.route in ("dropped", "fallback_to_light_cleaned")
    dropper = lambda c: (c, F.lit("drop"), F.lit(None).cast("string"))
    assert cleaner.audit(cleaner.clean_documents(docs, dropper)).first().fail_reasons == ["llm_decided_drop"]


def test_json_lines_and_shards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{bad\n{"id": "ü", "n": null}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert [(r.id, r.n) for r in df.collect()] == [("1", 2), ("ü", None)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int", strict=True).collect()
    assert [r.source_idx for r in files.read_lines(spark, str(tmp_path / "a.jsonl")).orderBy("source_idx").collect()] == [0, 1, 2, 3]
    rows = spark.createDataFrame([(i,) for i in range(10)], "row_idx int")
    files.write_shards(rows, str(tmp_path / "s"), 3)
    assert [r.row_idx for r in files.read_shards(spark, str(tmp_path / "s"), 3).collect()] == list(range(10))
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, str(tmp_path / "s"), 4)
    files.write_array(rows, str(tmp_path / "x.json"))
    assert sorted(r["row_idx"] for r in json.loads((tmp_path / "x.json").read_text())) == list(range(10))
    files.write_array(rows.withColumn("t", F.when(F.col("row_idx") > 3, "ü,\n]")).repartition(3), str(tmp_path / "y.json"))
    assert {(r["row_idx"], r["t"]) for r in json.loads((tmp_path / "y.json").read_text(encoding="utf-8"))} == {(i, "ü,\n]" if i > 3 else None) for i in range(10)}
    files.write_array(rows.where("false"), str(tmp_path / "z.json"))
    assert json.loads((tmp_path / "z.json").read_text()) == []
    rows.write.parquet(str(tmp_path / "p"))
    files.rewrite(spark, str(tmp_path / "p"), lambda t: t.where("row_idx > 4"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    (tmp_path / "p").rename(tmp_path / "p.old")  # as if a run had ended between its two renames
    files.rewrite(spark, str(tmp_path / "p"), lambda t: t.where("row_idx > 6"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and not (tmp_path / "p.old").exists()


def test_rules_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("# rules\nclf_keep: 4.5 # high\nunknown: 3\nnested:\n  clf_drop: 9\nmin_text_chars: '10'\n")
    r = files.load_rules(str(tmp_path / "r.yaml"))
    assert (r.clf_keep, r.min_text_chars, r.clf_drop) == (4.5, 10, 2.8) and files.load_rules(None) == files.load_rules("/no/file")


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    from tessera.streaming.progress import latest, run_available

    rows = [("a", 1, 1.0, False), ("a", 2, 0.0, False), ("b", 1, 1.0, True)], [("a", 3, 1.0, None), ("a", 1, 1.0, False), ("b", 2, 0.0, False)]
    shape = "sample_id string, step bigint, reward double, is_pg boolean"
    for part in rows:
        spark.createDataFrame(part, shape).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    last = {r.sample_id: r for r in latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    kept = [*rows[0], *rows[1]]  # the late row and the step that goes on in a later batch count as in a table
    want = {r.sample_id: r for r in progress.updated(progress.step_rates(spark.createDataFrame(kept, shape))).collect()}
    for k in ("a", "b"):
        assert (last[k].p, last[k].lp, last[k].n_updates, last[k].pg_p_ema, last[k].pg_seen) == (want[k].p, want[k].lp, want[k].n_updates, want[k].pg_p_ema, want[k].pg_seen)


def test_models_are_boundaries(spark):
    from tessera.operators.models import generated, label_score, rounds_done, scored_by

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 5000)], "id int, text string")
    assert {r.id: r.score for r in scored_by(df, "id", "text", lambda: lambda ts: [len(t) for t in ts]).collect()} == {1: 3.0, 2: 0.0, 3: 5.0}

    def broken():
        raise RuntimeError("no model")

    assert {r.score for r in scored_by(df.where("id = 1"), "id", "text", broken).collect()} == {None}
    assert [(r.id, r.sample_no, r.text) for r in generated(df.where("id = 1"), "id", "text", lambda: lambda ts: [t.upper() for t in ts], 2).collect()] == [(1, 0, "ABC"), (1, 1, "ABC")]
    assert [r.text for r in generated(df.where("id = 1"), "id", "text", broken).collect()] == [""]
    assert label_score("LABEL_3", 0.2) == 3.0 and label_score("good", 0.5) == 2.5 and rounds_done(90, 100) and not rounds_done(89, 100)


def test_guided_rows_join_by_sample(spark):
    q = spark.createDataFrame([("What is it?", "\n".join(["This is one line of a solution of forty one"] * 9), "9", "s1"), ("Other?", "no breaks", "1", "s2")], "question string, answer string, ground_truth string, sample_id string")
    c = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    rows = progress.guided_rows(c, q, 10).collect()
    assert len(rows) == 1 and rows[0].sample_id == "s1" and [m.role for m in rows[0].prompt] == ["system", "user", "assistant"]


def test_snapshots_come_back(spark, tmp_path):
    states = spark.createDataFrame([("a", 0.5, 0.1, 3, None, None), ("b", 0.01, 0.0, 2, 0.2, 1)], "sample_id string, p double, lp double, n_updates int, pg_p_ema double, pg_seen int")
    assert progress.load_states(spark, str(tmp_path / "s")) is None
    for _ in range(2):  # a snapshot replaces the one before
        progress.save_states(states, str(tmp_path / "s"), {"beta": 0.9})
    assert sorted(progress.load_states(spark, str(tmp_path / "s")).collect()) == sorted(states.collect())
    about = spark.read.json(str(tmp_path / "s" / "about")).first()
    assert about.config.beta == 0.9 and (about.summary.n, about.summary.n_hard, about.summary.n_sweet) == (2, 1, 1)


def test_states_follow_the_stated_updates(spark):
    rows = [("q1", 1, 0.0, False), ("q1", 2, 1.0, False), *(("q1", 2, 0.0, False),) * 3, ("q2", 1, 1.0, False), ("q2", 5, 1.0, None), ("q2", 5, 1.0, True)]
    df = progress.updated(progress.step_rates(spark.createDataFrame(rows, "sample_id string, step bigint, reward double, is_pg boolean")))
    at = {r.sample_id: r for r in df.withColumn("w", progress.weight(F.col("lp"))).collect()}
    assert at["q1"].p == pytest.approx(0.05) and at["q1"].lp == pytest.approx(0.05) and at["q1"].w == pytest.approx(1 / (1 + 2.718281828 ** (-0.4)) + 0.5)
    assert (at["q2"].p, at["q2"].lp, at["q2"].n_updates, at["q2"].pg_p_ema, at["q2"].w) == (1.0, 0.0, 2, 1.0, 1.0)


def test_models_in_the_cleaner(spark):
    docs = spark.createDataFrame([("d", "Let x = 1 + 2 - 3 * 4. " * 3), ("e", "We solve for x = 5 and y = 6. " * 4)], "id string, text string")
    rate = cleaner.scorer("model", lambda: lambda texts: [3.0 if "Let" in t else 4.9 for t in texts])
    keep = cleaner.rewriter("model", lambda: lambda texts: ["DECISION: light_clean\nTEXT:\n" + t for t in texts])
    got = {r.id[0]: r for r in cleaner.audit(cleaner.clean_documents(docs, keep, rate=rate)).collect()}
    assert (got["d"].route, got["d"].llm_decision, got["d"].classifier_score_raw, got["d"].classifier_score_post) == ("kept_llm_processed", "light_clean", 3.0, 3.0)
    assert (got["e"].route, got["e"].classifier_score_raw) == ("kept_light_cleaned", 4.9)

    def broken():
        raise RuntimeError("no service")

    got = {r.id[0]: r for r in cleaner.audit(cleaner.clean_documents(docs, cleaner.rewriter("model", broken), rate=rate)).collect()}
    assert got["d"].fail_reasons == ["llm_error: no service"] and got["d"].llm_decision == "error"
    rules, failed = (sorted(cleaner.audit(cleaner.clean_documents(docs, rate=x)).collect()) for x in (cleaner.rule_scorer, cleaner.scorer("model", broken)))
    assert rules == failed  # a scorer that fails leaves the rules' score
    for kind in (cleaner.scorer, cleaner.rewriter):
        with pytest.raises(ValueError, match="unknown"):
            kind("other")


@pytest.mark.parametrize(("reply", "want"), [("DECISION: rewrite\nTEXT:\n a b \n", ("rewrite", "a b")), ("DECISION: odd\nTEXT:\nx", ("keep_as_is", "x")), (" whole ", ("keep_as_is", "whole")), ("DECISION: DROP", ("drop", "DECISION: DROP"))])
def test_replies(spark, reply, want):
    from tessera.operators.models import parsed_reply

    assert tuple(spark.createDataFrame([(reply,)], "r string").select(*parsed_reply(F.col("r"))).first()) == want


def test_teachers_are_judged_anew(spark):
    shape = "id int, full_response string, ground_truth string, predicted string, is_correct boolean, response string"
    rows = [(1, "<think>a</think>so \\boxed{4}", "5", "4", True, "r"), (2, "<think>a</think>so \\boxed{\\frac{1}{2}}", "0.5", None, False, None), (3, "\\boxed{3}", "4", "9", None, "r"), (4, None, "4", None, None, None)]
    got = {r.id: (r.predicted, r.is_correct, r.response, r.change) for r in preference.rescored_teachers(spark.createDataFrame(rows, shape)).collect()}
    assert got == {1: ("4", True, "r", "kept"), 2: ("\\frac{1}{2}", True, "so \\boxed{\\frac{1}{2}}", "rescued"), 3: ("9", False, "r", "wrong"), 4: (None, False, None, "wrong")}


def student_round(spark, first, n):
    shape = "question string, ground_truth string, num_correct int, num_total int, responses array<struct<text: string, is_correct: boolean>>"
    rows = []
    for i in range(first, first + n):
        right = i % 5
        rows.append((f"q{i}", "1", right, 4 if right < 4 else right, [(f"{i}-{j}", j < right) for j in range(4)]))
    return spark.createDataFrame(rows, shape)


def test_rounds_are_assembled_and_iterated(spark):
    teachers = spark.createDataFrame([("q0", "t0"), ("q10", "t10"), ("q1", "t1")], "qkey string, teacher_response string")
    rounds = [(student_round(spark, 0, 10), teachers), (student_round(spark, 10, 10), teachers)]
    every = preference.assembled_rounds(rounds, 1000).collect()
    # of five questions: none right has the teacher's pair, one right none, two right two, three right one (one wrong), all right none
    assert sorted((r.source, r["round"]) for r in every) == sorted([("on_policy", k) for k in (1, 2) for _ in range(6)] + [("teacher_chosen", 1), ("teacher_chosen", 2)])
    some = preference.assembled_rounds(rounds, 13).collect()
    assert len(some) == 13 and sum(r.source == "on_policy" for r in some) == 12
    assert len(preference.assembled_rounds(rounds, 5).collect()) == 5
    asked = []

    def step(number):
        asked.append(number)
        return preference.round_pairs(*rounds[(number - 1) % 2], number)

    assert len(preference.iterated(step, 14, 9)) == 2 and asked == [1, 2]  # 7 pairs a round, 14 asked for
    assert len(preference.iterated(step, 1000, 3)) == 3 and preference.iterated(step, 0, 3) == []


def test_paired_batches_leave_out_what_cannot_be_trained(spark):
    from tessera.functions import tokens

    shape = "id int, prompt_ids array<int>, told_ids array<int>, response_ids array<int>, attention array<int>, mask array<int>"
    rows = [(1, [1, 2], [1, 2, 3], [7, 8, 0], [1, 1, 0], [1, 0, 0]), (2, [], [1], [7], [1], [1]), (3, [1], [1], [7, 8], [0, 0], [1, 1]), (4, [1], [1], [7, 8], [1, 1], [0, 0]), (5, [1], [1], [7, 8, 9, 6], [1, 1, 1, 1], [1, 1, 0, 1])]
    df = spark.createDataFrame(rows, shape)
    got = {r.id: r for r in tokens.paired_batch(df, 4, 0, "prompt_ids", "told_ids", "mask", ["id"]).collect()}
    assert sorted(got) == [1, 5] and got[1].student_input_ids == [1, 2, 7, 8] and got[1].teacher_input_ids == [2, 3, 7, 8]
    assert got[1].student_loss_mask == [0, 0, 1, 0] and got[5].student_input_ids == [1, 7, 8, 9] and got[5].student_loss_mask == [0, 1, 1, 0]
    one = tokens.paired_batch(df, 6, 9, carried=["id"]).collect()
    assert sorted(r.id for r in one) == [1, 4, 5] and all(r.student_input_ids == r.teacher_input_ids for r in one)
    assert next(r for r in one if r.id == 1).student_input_ids == [1, 2, 7, 8, 9, 9]


def test_ratio_splits(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    for ratio, head in ((0.8, 8), (0.0, 0), (1.0, 11)):
        split = [r.split for r in selection.split_ratio(df, "k", ratio).collect()]
        assert (split.count("train"), split.count("val")) == (head, 11 - head)
