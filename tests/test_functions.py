"""Cleaning, segments, answers, prefixes, rewards and token functions against small examples and brute force."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, reward, similarity, tokens
from tessera.functions.cleaning import BOILERPLATE_LINE, drop_lines, plain_marks, with_clean_text
from tessera.functions.features import Rules, feature_struct, route, score
from tessera.functions.validation import validate
from tessera.operators import segment

NOISY = [
    ("https://a.org/x", ""), ("Skip to content", ""), ("Posted on", ""), ("Updated: 1/2/2020", ""), ("Re: hello", ""), ("Apr 19, 2018", ""), ("Wiki User", ""), ("14y ago", ""), ("Concept: Sets", ""), ("Quick Links", ""), ("All times are GMT", ""),
    ("We use cookies here", ""), ("next page", ""), ("Reposted on a whim", "Reposted on a whim"), ("a[sup]2[/sup]", "a^{2}"), ("[b]x[/b] y", "x y"), ("[url=http://q]z[/url]kept", "kept"), ("&amp;lt; is less", "is less"), ("x\n\n\n\n\ny", "x\n\ny"), ("same\nsame\nother", "same\nother"), ("fine :)", "fine"),
    ("text\nRelated Posts:\nmore", "text"), ("5\nbody", "body"), ("go http://a.b/c now", "go  now"),
]


def test_cleaning_steps(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOISY)], "i int, t string")
    got = {r.i: r.c for r in with_clean_text(df, "t", "c").collect()}
    for i, (text, want) in enumerate(NOISY):
        assert got[i] == want, text


def test_null_and_empty_text_stay(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r.c for r in with_clean_text(df, "t", "c").collect()] == [None, ""]
    row = df.select(score(feature_struct("t")).alias("s"), plain_marks(F.col("t")).alias("p"), drop_lines(F.col("t"), BOILERPLATE_LINE).alias("d")).collect()
    assert row[1].s is not None and row[0].p is None


def test_features_of_known_text(spark):
    df = spark.createDataFrame([("We improve x_1 + 2 = 3, a theorem: \\frac{1}{2} 证明",)], "t string").select(feature_struct("t").alias("f"))
    f = df.first().f
    assert (f.symbol_count, f.latex_cmd_count, f.number_count, f.variable_like_count, f.math_keyword_count, f.has_proof_signal) == (2, 1, 5, 1, 2, True)
    assert df.select(route(score(F.col("f")), F.col("f")).alias("r")).first().r in ("keep", "llm", "drop")


def test_segments_hold_all_text_and_bounds():
    rng = random.Random(3)
    words = ["alpha", "beta.", "gamma!", "$$x$$", "\n\n", "# Head\n", "delta\n"]
    for _ in range(200):
        text = " ".join(rng.choice(words) * rng.randint(1, 30) for _ in range(rng.randint(0, 60)))
        parts = segment.segments(text)
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(len(p) <= Rules().hard_max_chars for p in parts)
        assert all(min(len(a), len(b)) >= Rules().min_segment_chars or len(a) + len(b) + 2 > Rules().hard_max_chars for a, b in zip(parts, parts[1:]))
    assert segment.segments(None) == segment.segments(" \n ") == []


@pytest.mark.parametrize(
    ("family", "text", "gt", "correct"),
    [
        ("nested", r"so \boxed{\frac{1}{2}}", "0.5", True), ("nested", r"\\boxed{5}", "5", True), ("nested", r"\boxed{\boxed{5}}", "5", True), ("nested", r"\boxed{5", "5", False), ("nested", r"\boxed{1,234}", "1234", True), ("nested", r"\boxed{0.3}", "0", False),
        ("nested_whole_first", r"\boxed{0.3}", "0", True), ("nested", r"\boxed{1d}", "1", False), ("nested", r"\boxed{nan}", "nan", False), ("nested", r"\boxed{1/0}", "1", False), ("exam", r"x: \boxed{x \in [-2, 7]}", "[-2,7]", True), ("exam", r"\boxed{\dfrac{2}{4}}", "1/2", True), ("exam", "answer is 7.\n", "7", True),
        ("word_problem", "#### 1,200", "1200", True), ("word_problem", "**12** then *Note: 9", "12", True), ("few_shot", r"\boxed{\text{cm}3.}", "cm3", True), ("few_shot", "3", "3", False), ("few_shot_word", "a = 18.000000001", "18", True), ("few_shot_word", "x", "1", False),
    ],
)
def test_answer_families(family, text, gt, correct):
    assert answers.JUDGES[family](text, gt)[1] is correct


def test_reward_family():
    assert answers.judge_final("a\nAnswer: 7", "7")["acc"]
    near = answers.judge_final(r"\boxed{100.5}", "100")
    assert not near["acc"] and near["near_correct"] and near["has_boxed"]
    assert answers.judge_final(r"\boxed{5}" + "x" * 300, "5")["pred"] == "[INVALID]"
    assert answers.final_form("x = 12 cm") == "12"


def test_native_answers(spark):
    rows = [(r"\boxed{1} and \boxed{2}", "2"), ("the answer is 3/4.", "0.75"), ("none", "1"), (None, "1"), (r"\boxed{1/0}", "1")]
    df = spark.createDataFrame(rows, "t string, g string").select(answers.close(answers.ratio_number(answers.flat_boxed("t")), answers.ratio_number("g")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, False, False, False, False] or [r.ok for r in df.collect()] == [True, True, False, False, False]
    think = spark.createDataFrame([("<think>a</think> b",), ("a</think>b",), ("<think>x</think>",)], "t string").select(answers.without_thinking("t").alias("w"), answers.with_thinking("t").alias("m")).collect()
    assert [r.w for r in think] == ["b", "a</think>b", "<think>x</think>"] and think[1].m == "<think>\na</think>b"


def test_lines_cannot_leak():
    text = "First step.\n\nThen = 42\nmore\nthe end is far away from here and longer\nx"
    for ratio in (0.2, 0.4, 0.6):
        p = similarity.cut(text, ratio, similarity.breakpoints(text))
        assert p is None or (text.startswith(p) and 0.05 * len(text) <= len(p) <= 0.8 * len(text))
    assert similarity.leaks("a \\boxed{42}", "42") and not similarity.leaks("a 42", "42")
    assert similarity.safe_prefix("no breaks", "1", 0.4, 3) is None and similarity.safe_prefix(None, "1", 0.4, 3) is None


def test_common_subsequence_by_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_subsequence(a, b) == table[-1][-1]


def test_loops_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        unit = [str(rng.randint(0, 3)) for _ in range(rng.choice([6, 8, 5]))]
        ts = [str(rng.randint(0, 9)) for _ in range(45)] + unit * rng.randint(1, 4)
        best = 1
        for n in (6, 8):
            for i in range(len(ts) - 2 * n + 1):
                k = 1
                while ts[i + k * n : i + (k + 1) * n] == ts[i : i + n]:
                    k += 1
                best = max(best, k)
        assert reward.loop_penalty(" ".join(ts)) == pytest.approx(min(0.04, 0.02 * (best - 1)) if len(ts) >= 48 else 0)


def test_shared_runs_at_the_bound(spark):
    a = "x" * 10 + "".join(chr(97 + i % 26) for i in range(50)) + "y" * 5
    rows = [(a, "q" + a[10:60] + "z"), (a, "q" + a[10:61] + "z"), ("", ""), (None, "a")]
    assert [r.s for r in spark.createDataFrame(rows, "a string, b string").select(similarity.shares_run("a", "b").alias("s")).collect()] == [False, True, False, False]


def test_token_functions(spark):
    rng = random.Random(4)
    s, t = ([rng.gauss(0, 2) for _ in range(6)] for _ in range(2))
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    p, q = soft(s), soft(t)
    kl = lambda a, b: sum(x * math.log(x / y) for x, y in zip(a, b))
    m = [(x + y) / 2 for x, y in zip(p, q)]
    a, b = F.col("s"), F.col("t")
    r = spark.createDataFrame([(s, t)], "s array<double>, t array<double>").select(tokens.reverse_kl(a, b).alias("r"), tokens.forward_kl(a, b).alias("f"), tokens.js_divergence(a, b).alias("j"), tokens.entropy(a).alias("e")).first()
    assert (r.r, r.f, r.j, r.e) == pytest.approx((kl(p, q), kl(q, p), (kl(p, m) + kl(q, m)) / 2, -sum(x * math.log(x) for x in p)))


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1], []), (list(range(9)), [7] * 9)], "p array<int>, r array<int>").select(tokens.padded(F.col("p"), F.col("r"), 4, 0).alias("b"))
    a, b, c = (r.b for r in df.collect())
    assert (a.input_ids, a.loss_mask, b, c.input_ids) == ([2, 3, 4, 5], [0, 0, 1, 1], None, [8, 7, 7, 7])


def test_validation_reasons(spark):
    df = spark.createDataFrame([("a = 1 + 2 (x) $y$", "a = 1 + 2 (x) $y$"), ("n 1 2 3 4", "n 1 $")], "a string, b string").select(validate(F.col("a"), F.col("b"), F.lit(2.0)).alias("v")).collect()
    assert df[0].v.validation_pass and not df[1].v.validation_pass and df[1].v.fail_reasons[0].startswith("number_recall=0.25<")


def test_sampling_by_weight(spark):
    u = lambda seed, *keys: int(hashlib.sha1("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:12], 16) / 16**12
    rng = random.Random(8)
    rows = [(i, [rng.choice([1e-8, 0.5, 1.0, 3.0]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 9, 40] * 20)]
    df = spark.createDataFrame(rows, "i int, w array<double>").select("i", *(tokens.sampled(F.col("w"), r, 7, "i").alias(f"s{k}") for k, r in enumerate((0.1, 0.5, 1.0))))
    for x in df.collect():
        w = rows[x.i][1]
        order = sorted(range(len(w)), key=lambda j: -math.log(max(u(7, x.i, j), 2.0**-49)) / w[j])
        for r, got in ((0.1, x.s0), (0.5, x.s1), (1.0, x.s2)):
            assert got == sorted(order[: max(1, int(len(w) * r))])
    many = spark.range(4000).select(tokens.sampled(F.array(F.lit(1.0), F.lit(3.0)), 0.5, 1, "id").alias("s")).where("s[0] = 1").count()
    assert abs(many / 4000 - 0.75) < 0.03
