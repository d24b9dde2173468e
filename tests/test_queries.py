"""Queries do the whole job: nothing of their tables is left out."""

from __future__ import annotations

import hashlib
import json
import re

import pytest

from tessera.operators import preference, progress
from tessera.plans.queries import QUERIES


def test_all_observations_are_weighted(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i % 2), False) for i in range(1, 41)] + [("c", None, 1.0, False), (None, 10, 1.0, False)]
    obs = spark.createDataFrame(rows, "sample_id string, step bigint, reward double, is_pg boolean")
    obs.write.parquet(str(tmp_path / "lp_observations.parquet"))
    weights = {r.sample_id: r.w for r in progress.updated(progress.step_rates(obs)).select("sample_id", progress.weight(progress.F.col("lp")).alias("w")).collect()}
    want = {k: sum(1 for x in rows if x[0] == k) for k in ("a", "b", "c", None)}
    got = {r.sample_id: r for r in QUERIES["lp_advantages"](spark, str(tmp_path)).collect()}
    assert {k: r.n for k, r in got.items()} == want
    assert {k: r.total for k, r in got.items()} == pytest.approx({k: n * weights.get(k, 1.0) for k, n in want.items()}, abs=1e-4)


def test_preference_texts_are_whole(spark, tmp_path):
    good, bad = "We add both. " * 40 + "\\boxed{4}", "We guess a number. " * 30 + "\\boxed{5}"
    shape = "row_idx bigint, question string, ground_truth string, num_correct int, num_total int, responses array<struct<text: string, predicted_answer: string, is_correct: boolean>>"
    responses = [(good, "4", True), (bad, "5", False)]
    spark.createDataFrame([(0, "What is 2 + 2?", "4", 1, 2, responses)], shape).write.parquet(str(tmp_path / "student_responses.parquet"))
    rows = QUERIES["preference_format"](spark, str(tmp_path)).collect()
    assert [(json.loads(r.chosen)["value"], json.loads(r.rejected)["value"]) for r in rows] == [(good, bad)]
    df = spark.createDataFrame([("q", good, "no")], "prompt string, chosen string, rejected string")
    for most, want in ((None, good), (200, good[:200]), (10**6, good)):
        cut = preference.preference_rows(df, most).first()
        assert (cut.chosen.value, cut.rejected.value) == (want, "no")


def test_sequences_hold_whole_texts(spark, tmp_path):
    items = [(1, "What is the sum? " * 20, "It is found so. " * 30), (2, "a", "b"), (3, "long prompt " * 2000, "c" * 10), (4, "p", "d" * 17000)]
    spark.createDataFrame(items, "item_id bigint, problem string, solution string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {r.item_id: r for r in QUERIES["padded_sequences"](spark, str(tmp_path)).collect()}
    for i, *texts in items:
        p, s = ([ord(c) for c in re.sub("[^a-z]", "", x.lower())] for x in texts)
        s = s[:16383]
        p = p[-(16384 - len(s)) :]
        rest = [0] * (16384 - len(p) - len(s))
        assert json.loads(got[i].input_ids) == p + s + rest
        assert json.loads(got[i].loss_mask) == [0] * len(p) + [1] * len(s) + rest


def test_tokens_are_sampled_from_all_sequences(spark, tmp_path):
    rows = [(i, [float((i * j) % 7) for j in range(5)]) for i in range(70)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["token_samples"](spark, str(tmp_path)).collect()
    assert sorted((r.sequence, r.n_total) for r in got) == [(0, 32)] * 16 + [(1, 32)] * 16 + [(2, 6)] * 3
    assert all(r.vec_id == 32 * r.sequence + r.token for r in got) and len({r.vec_id for r in got}) == len(got)


def test_shuffle_holds_all_rows(spark, tmp_path):
    spark.createDataFrame([(i, 0.5) for i in range(300)], "row_idx bigint, student_accuracy double").write.parquet(str(tmp_path / "dpo_questions_24k_v2.parquet"))
    order = sorted(range(300), key=lambda i: hashlib.sha1(f"42|{i}".encode()).hexdigest())
    assert [r.row_idx for r in QUERIES["shuffled_rows"](spark, str(tmp_path)).orderBy("position").collect()] == order
    assert sorted(r.position for r in QUERIES["shuffled_rows"](spark, str(tmp_path)).collect()) == list(range(300))
    assert [r.row_idx for r in QUERIES["hash_shuffle"](spark, str(tmp_path)).collect()] == order[:50]
