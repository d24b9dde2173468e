"""Operators on training text: brute force, exact round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.words import words
from tessera.llm import leakage, mainbody, markup, packing, pairs, quality, quota_sample, repetition, residue

# --- 1 quotas ------------------------------------------------------------------------------------------------

PLAN = [(1, 1, "几何", "Geometry", 0.5, 2, 10), (1, 2, "数论", "Number Theory", 0.3, 4, 10), (1, 3, "x", None, 0.2, 0, 10)]
PLAN_SHAPE = "plan_id int, category_id int, category string, name_en string, target_share double, min_rows int, sample_rows int"


def test_labels_are_read_through_width_space_and_case(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "GeoMetry")
    rows = [(1, " 几 何\n", 0), (1, "geometry", 0), (2, wide, 1), (3, "NUMBER THEORY", None), (4, None, 1), (5, " ", 1), (None, "几何", 1), (6, "other", 1)]
    held = quota_sample.available(spark.createDataFrame(rows, "id bigint, category string, band int"), spark.createDataFrame(PLAN, PLAN_SHAPE))
    told = {r.category_id: (r.available, r.needed, r.missing) for r in quota_sample.report(held, spark.createDataFrame(PLAN, PLAN_SHAPE)).collect()}
    assert told == {1: (2, 5, 3), 2: (1, 4, 3), 3: (0, 2, 2)}


def test_sample_follows_quotas(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["几何"] * 8 + ["数论", "x"]), rng.randint(0, 3)) for i in range(4000)]
    plan = [(1, 1, "几何", "Geometry", 0.2, 0, 300), (1, 2, "数论", "NT", 0.5, 0, 300), (1, 3, "x", "y", 0.3, 95, 300)]
    plans = spark.createDataFrame(plan, PLAN_SHAPE)
    held = quota_sample.available(spark.createDataFrame(rows, "id bigint, category string, band int"), plans)
    drawn = quota_sample.draw(held, quota_sample.report(held, plans)).collect()
    assert Counter(r.category_id for r in drawn) == {1: 57, 2: 148, 3: 95}  # what the minimum of 3 takes is given up in turn by the others
    assert len({(r.category_id, r.id) for r in drawn}) == len(drawn) == 300
    assert sorted(drawn) == sorted(quota_sample.draw(held.repartition(5), quota_sample.report(held, plans)).collect())


def test_raking_meets_both_margins():
    counts = {(r, c): float(1 + 3 * r + c * c) for r in range(3) for c in range(4)}
    rows, columns = {0: 10.0, 1: 20.0, 2: 30.0}, {0: 6.0, 1: 14.0, 2: 15.0, 3: 25.0}
    w = quota_sample.rake(counts, rows, columns)
    for side, want in ((0, rows), (1, columns)):
        for k, v in want.items():
            assert sum(w[x] * n for x, n in counts.items() if x[side] == k) == pytest.approx(v)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40), st.integers(0, 10)), min_size=1, max_size=6), st.integers(0, 80))
def test_quota_numbers(cells, total):
    shares = sum(a for a, _, _ in cells) or 1
    want = {i: total * a / shares for i, (a, _, _) in enumerate(cells)}
    have, least = {i: h for i, (_, h, _) in enumerate(cells)}, {i: min(h, m) for i, (_, h, m) in enumerate(cells)}
    got = quota_sample.quotas(want, least, have, total)
    assert all(least[i] <= got[i] <= have[i] for i in got)
    assert sum(got.values()) == min(max(total, sum(least.values())), sum(have.values())) or not any(want.values())


def test_empty_plans_and_rows(spark):
    no_rows, no_plans = spark.createDataFrame([], "id bigint, category string, band int"), spark.createDataFrame([], PLAN_SHAPE)
    plans = spark.createDataFrame(PLAN, PLAN_SHAPE)
    held = quota_sample.available(no_rows, plans)
    assert quota_sample.report(held, plans).where("missing > 0").count() == 3 and quota_sample.draw(held, quota_sample.report(held, plans)).count() == 0
    assert quota_sample.report(quota_sample.available(no_rows, no_plans), no_plans).count() == 0


# --- 2 repetition --------------------------------------------------------------------------------------------


def slow_share(text: str) -> float:
    ws = words(text)
    hit = [False] * len(ws)
    for i in range(len(ws) - 4):
        if any(ws[j : j + 5] == ws[i : i + 5] for j in range(i)):
            hit[i : i + 5] = [True] * 5
    return sum(len(w) for w, h in zip(ws, hit) if h) / (sum(map(len, ws)) or 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "Def", "g1"]), max_size=40))
def test_repeated_share_by_brute_force(ws):
    assert repetition.repeated_share(" ".join(ws)) == pytest.approx(slow_share(" ".join(ws)))


def test_repetition_in_characters_and_edges(spark):
    assert repetition.repeated_share("今天天气很好我们出去玩。" * 3) > 0.6 and repetition.repeated_share("今天天气很好") == repetition.repeated_share("") == 0.0
    text = "one two three four five. "
    rows = [("t", "1", text * 3), ("t", "1", text * 3), ("t", "2", text), ("t", None, text * 3), ("t", "3", None), ("t", "4", " ")]
    assert [(r.rec_key, round(r.share, 2)) for r in repetition.repeated(spark.createDataFrame(rows, "rec_table string, rec_key string, text string")).collect()] == [("1", 0.67)]


def slow_kneser_ney(texts: list[list[str]], d3: list[float], d2: list[float]):
    tri = Counter(g for t in texts for s in [["<", "<", *t]] for g in zip(s, s[1:], s[2:]))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    cut = lambda d, n: d[min(n, 3)]
    types, kinds = sum(uni.values()), len(uni)

    def p(u, v, w):
        p1 = (uni[w] + 0.5) / (types + 0.5 * (kinds + 1)) if w in uni else 1e-9
        t2 = sum(n for (a, _), n in bi.items() if a == v)
        p2 = max(bi[v, w] - cut(d2, bi[v, w]), 0) / t2 + sum(cut(d2, n) for (a, _), n in bi.items() if a == v) / t2 * p1 if t2 else p1
        t3 = sum(n for (a, b, _), n in tri.items() if (a, b) == (u, v))
        return max(tri[u, v, w] - cut(d3, tri[u, v, w]), 0) / t3 + sum(cut(d3, n) for (a, b, _), n in tri.items() if (a, b) == (u, v)) / t3 * p2 if t3 else p2

    return p


def test_perplexity_by_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    df = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "rec_table string, rec_key string, text string")
    model = repetition.fit(df)
    d3, d2 = (repetition.discounts(x, "n") for x in model["_held"])
    p = slow_kneser_ney([t.split() for t in texts], d3, d2)
    for shard in (10**9, 20):  # one shard, and several
        got = {r.rec_key: r.perplexity for r in repetition.perplexity(df, shard_ngrams=shard).collect()}
        for i, t in enumerate(texts):
            s = ["<", "<", *t.split()]
            want = math.exp(-sum(math.log(p(*g)) for g in zip(s, s[1:], s[2:])) / (len(s) - 2))
            assert got[str(i)] == pytest.approx(want, rel=1e-4)


def test_hashes_are_those_of_the_engine(spark):
    rng = random.Random(9)
    rows = [tuple(rng.randint(-(2**62), 2**62) for _ in range(3)) for _ in range(50)]
    got = [r.h for r in spark.createDataFrame(rows, "u bigint, v bigint, w bigint").select(F.xxhash64("u", "v", "w").alias("h")).collect()]
    import numpy as np

    assert repetition.key(*np.array(rows, np.int64).T).tolist() == got


def test_perplexity_bands_and_edges(spark):
    rng = random.Random(10)
    say = lambda ws: " ".join(rng.choice(ws) for _ in range(12))
    rows = [("t", f"e{i}", say(["the", "of", "and", "cat", "is"])) for i in range(60)] + [("t", f"d{i}", say(["der", "und", "nicht", "katze", "ist"])) for i in range(60)]
    rows += [("t", "n", None), ("t", None, "the cat"), ("t", "b", " ... "), ("t", "e0", rows[0][2]), ("t", "long", "the cat is of " * 5000)]
    df = spark.createDataFrame(rows, "rec_table string, rec_key string, text string")
    out = {r.rec_key: r for r in repetition.perplexity(df, 0.05, 0.95, own=50).collect()}
    assert len(out) == 121 and out["e1"].lang == "en" and out["d1"].lang == "de" and out["long"].n_words == 20000
    assert len({(r.lower, r.upper) for r in out.values()}) == 2 and out["e1"].lower != out["d1"].lower
    assert all(r.rejected == (r.perplexity < r.lower or r.perplexity > r.upper) for r in out.values()) and out["long"].rejected
    assert repetition.perplexity(df.where("false")).count() == 0


# --- 3 quality -----------------------------------------------------------------------------------------------

PROSE = "We first look at the shape of the curve and then find its area. This is what the proof needs, and it holds for all numbers. "


def test_kinds_of_content():
    share = lambda t: {k: v / (sum(quality.content(t).values()) or 1) for k, v in quality.content(t).items()}
    assert share(PROSE * 3)["prose"] == 1
    assert share("Here they are.\n" + "\n".join(f"- item {w}" for w in ("red", "green", "blue", "deep grey", "pale pink")))["list"] > 0.7
    assert share("a\tb\tc\n" + "\n".join(f"x{i}\t{i}\t{i * 2}" for i in range(9)))["table"] == 1
    assert share("xq zzkrt vvbn|1l qwrtz\n" * 6)["junk"] > 0.9
    assert share("name     size     cost\n1        64\nred      22.7     n/a\ngreen             24\nblue     3        9\n")["table"] == 1
    assert share("61 55 9c c6 85 10 5e 51\n05 04 5a 82 2c ca 87 87\n" * 3)["junk"] == 1 and share("61 55 12 34 85 10 57 51")["junk"] == 0
    wrapped = re.sub(r"(.{30,45}?) ", r"\1\n", PROSE * 2)
    assert share(wrapped)["prose"] == 1 and share("")["prose"] == 0


def test_tails_and_edges(spark):
    rows = [(f"p{i}", PROSE * (1 + i % 4)) for i in range(60)] + [("l", "\n".join(f"* thing {i} of it" for i in range(20))), ("n", None), ("e", " "), (None, PROSE), ("long", PROSE * 4000)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert [(r.id, r.kind) for r in quality.not_prose(df).collect()] == [("l", "list")]
    at = {r.id: r for r in quality.placed(quality.measured(df)).collect()}
    assert at["l"].list_share_z > 3.5 and 0 <= at["p1"].n_words_pct <= 1 and at["long"].n_chars_pct >= 0.98
    assert quality.not_prose(df.where("false")).count() == 0


def test_common_kinds_are_found(spark):
    the_list = "\n".join(f"* the {w} of it and that" for w in ("sum", "root", "area", "side", "edge", "base", "cube", "rest"))
    junk = "xq zzkrt vvbn|1l qwrtz\n" * 6
    rows = [(f"p{i}", PROSE * (1 + i % 4)) for i in range(100)] + [(f"l{i}", the_list) for i in range(60)] + [(f"j{i}", junk) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {r.lang for r in quality.measured(df).where("id like 'l%'").collect()} == {"en"}
    assert {r.lang for r in quality.measured(df).where("id like 'j%'").collect()} == {"und"}
    want = {(f"l{i}", "list") for i in range(60)} | {(f"j{i}", "junk") for i in range(60)}
    assert {tuple(r) for r in quality.not_prose(df).collect()} == want
    assert {(r.id, r.kind) for r in quality.kinds(df).where("kind is not null").collect()} == want


def test_tails_follow_the_prose_of_a_language(spark):
    shape = "id string, lang string, list_share double, table_share double, junk_share double"
    rows = [(f"e{i}", "en", 0.004 * (i % 100), 0.0, 0.0) for i in range(400)] + [(f"d{i}", "de", 0.0, 0.0, 0.0) for i in range(100)] + [(f"x{i}", "en", 1.0, 0.0, 0.0) for i in range(400)]
    stats = spark.createDataFrame(rows, shape)
    begins = quality.tails(stats)
    # German prose holds no items: its tail begins half way to 1; English prose holds up to 0.4 of items
    assert begins["de"]["list"] == 0.5
    assert begins["en"]["list"] == pytest.approx((1 + 0.396) / 2, abs=0.02)
    at = spark.createDataFrame([("a", "en", 0.6, 0.0, 0.0), ("b", "de", 0.6, 0.0, 0.0), ("c", "en", 0.9, 0.0, 0.0)], shape)
    assert {r.id: r.k for r in at.select("id", quality.kind(begins).alias("k")).collect()} == {"a": None, "b": "list", "c": "list"}


def test_wrapped_lines_of_one_block_take_linear_time():
    block = "\n".join("so the sum of all parts goes on and" if i % 4 else "it ends here. It then" for i in range(40_000))
    assert quality.content(block)["prose"] > 900_000


def test_lists_are_found_among_prose_with_items(spark):
    items = [f"* the {w} of it" for w in ("sum", "root", "area", "side", "edge", "base", "cube", "rest")]
    rows = [(f"p{i}", PROSE + "\n" + "\n".join(items[: 7 * (i % 2)])) for i in range(80)] + [("l", "\n".join(items))]
    df = spark.createDataFrame(rows, "id string, text string")
    at = {r.id: r for r in quality.kinds(df).collect()}
    assert at["l"].list_share == 1 and at["l"].list_share_z < 3.5
    assert [(r.id, r.kind) for r in quality.not_prose(df).collect()] == [("l", "list")]


# --- 4 markup ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "found", "clean"),
    [
        ("<h2>Title</h2>\n<p>a &lt; b</p>\n<ul>\n<li>one</li>\n</ul>", ["html"], "## Title\na < b\n- one"), ("# Head\n**bold** and `code` ~~gone~~", ["markdown"], "# Head\nbold and code gone"), ("== Head ==\n'''b''' [[page|link]] {{note|x}}", ["wiki"], "## Head\nb link "),
        ("\\section{Head}\\label{a}\n\\textbf{b} {\\it c} \\vspace{2mm}\n\\begin{itemize}\n\\item one\n\\end{itemize}", ["latex"], "## Head\nb c\n- one"), ("a < b and b > 3, $x_1 * y_2 * z$ and \\boxed{3}", [], None), ("acc += 8 * j ** 2\n- item\n1. item", [], None), ("[[1, 2], [3, 4]] and {{1}, {2}}", [], None), ("A sentence here.\n---\nmore", [], None), ("", [], None), ("^%#%>@|)($#}#+{@^][[+$ ~~a~~ **x**", [], None),
    ],
)
def test_markup(text, found, clean):
    got, notations = markup.clean(text)
    assert notations == found and got == (text if clean is None else clean.rstrip())


BODY = "We first look at the <b>shape</b> of the curve and then find its area, which the proof needs for all numbers, and it holds for each of the sides that were drawn before it."
SITE = f"""Home | News | Shop
Forum
Contact us

<h2>The area</h2>

{BODY}

<ul>
<li>red sides</li>
<li>green sides</li>
</ul>

<pre>
x = area(a)
print x
</pre>

$$a^2 + b^2 = c^2$$

{BODY}

* the last item
$x = 3$
Answer: 4

Print this page
Back to top
Copyright Some Site"""


def test_lines_outside_the_blocks_go_and_structure_stays(monkeypatch):
    got, found = markup.clean(SITE)
    lines = got.split("\n")
    assert found == ["html"] and "<" not in got
    for kept in ("## The area", "- red sides", "- green sides", "```", "x = area(a)", "print x", "$$a^2 + b^2 = c^2$$", "* the last item", "$x = 3$", "Answer: 4"):
        assert kept in lines
    for gone in ("Home | News | Shop", "Forum", "Contact us", "Print this page", "Back to top", "Copyright Some Site"):
        assert gone not in lines
    monkeypatch.setattr(markup, "line_blocks", lambda sizes: [(0, len(sizes))])
    assert "Back to top" in markup.clean(SITE)[0]  # without the blocks nothing is cut


def test_short_texts_stay_whole():
    assert markup.clean("**Answer: 4**") == ("Answer: 4", ["markdown"])
    assert markup.clean("Title\n\n" + BODY + "\n\nas was shown") == ("Title\n\n" + re.sub("</?b>", "", BODY) + "\n\nas was shown", ["html"])
    assert markup.clean("\n".join(f"**red {w}**" for w in "abcde"))[0] == "\n".join(f"red {w}" for w in "abcde")
    assert markup.clean("**$12 = 3$**")[1] == ["markdown"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30))
def test_blocks_by_brute_force(sizes):
    bound = min(100, 0.35 * max((sum(sizes[i : i + 3]) for i in range(len(sizes))), default=0))
    high = {i for i in range(len(sizes)) if sum(sizes[i : i + 3]) > bound}
    got = markup.line_blocks(sizes)
    assert {i for a, b in got for i in range(a, b)} <= high and all(i in {k for a, b in got for k in range(a, b)} for i in high if sizes[i] * 3 > bound)
    assert all(b == len(sizes) or b not in high for _, b in got)


def test_markup_records(spark):
    rows = [("t", "1", "<b>x</b> word **y**"), ("t", "1", "<b>x</b> word **y**"), ("t", "2", None), ("t", None, "<b>x</b>"), ("t", "3", " ")]
    out = markup.residue(spark.createDataFrame(rows, "rec_table string, rec_key string, text string"))
    assert sorted((r.rec_key, r.markup) for r in out.collect()) == [("1", "html"), ("1", "markdown")]


# --- 5 pairs -------------------------------------------------------------------------------------------------

ASK = "A baker sells 12 loaves and buys 30 more from the mill. How many loaves are there in total?"


@pytest.mark.parametrize(
    ("response", "defect"),
    [
        (None, "empty"), ("\u200b \u3000", "empty"), ("...", "empty"), ("I'm sorry, but I can't help with this task.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("Sorry for the detour; we can't divide by zero, so n = 3 stays and the sum is found.\nAnswer: 42", None), (ASK.upper(), "copy"), ("You ask: " + ASK, "copy"),
        (ASK + " We add the two numbers: the old loaves and those that came. The sum of both is forty-two, so they hold more than before.\nAnswer: 42", None), ("El resultado es la suma de los dos números que hay en la tienda.", "language"), ("We add both numbers and then", "truncated"), ("We get $\\frac{1}{2", "truncated"), ("$42$", None), ("42", None), ("Answer: 42", None), ("The sum is \\boxed{42}", None), ("We add them all.", None),
    ],
)
def test_defects(response, defect):
    assert pairs.defect(ASK, response) == defect


def test_copied_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 14))] for _ in range(2))
        hit = pairs.SuffixAutomaton(a).covered(b, 3)
        runs = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
        want = [any(tuple(b[i : i + 3]) in runs for i in range(max(0, k - 2), min(k, len(b) - 3) + 1)) for k in range(len(b))]
        assert hit == want


def test_pair_records(spark):
    rows = [(1, ASK, None, "clash"), (1, ASK, None, "clash"), (2, None, "fine.", ""), (None, ASK, None, ""), (3, None, "cut off in the", "")]
    out = pairs.defects(spark.createDataFrame(rows, "gen_id bigint, question string, continuation string, defect string")).collect()
    assert sorted((r.gen_id, r.defect) for r in out) == [(1, "empty"), (3, "truncated")]


# --- 6 main body ---------------------------------------------------------------------------------------------

PAGE = "Home | News | Shop | Help | Log in\nHome > News\n\nAbout us all\n\n" + PROSE + "\nPrint this page\n\n" + PROSE + "\n\nRelated posts\n- About you\n» More of it (12)\nPowered by Xyz 1.2"


def test_main_body_of_a_page(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", PROSE), ("c", None), (None, PAGE), ("d", "")], "id string, text string")
    lines = sorted(r.line_no for r in mainbody.furniture_lines(df).collect())
    assert lines == [0, 1, 6, 10, 11, 12, 13]
    bodies = {r.id: r.body for r in mainbody.bodies(df).collect()}
    assert bodies["b"] == PROSE and bodies["d"] == "" and bodies["a"].startswith("About us all") and "Print" not in bodies["a"]


def planted_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of invented words, and the numbers of its furniture lines."""
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    menu = ["Home", "News", "Shop", "Help", "Log in", "Forum", "Contact us", "Archive"]
    lines: list[str] = []
    off: list[int] = []

    def add(text: str, tag: bool) -> None:
        if tag:
            off.append(len(lines))
        lines.append(text)

    rng.shuffle(menu)
    for x in [" | ".join(menu[:5])] if rng.random() < 0.5 else ["* " + m for m in menu[:4]]:
        add(x, True)
    add("Home > " + rng.choice(["News", "Shop"]), True)
    add("", False)
    add(" ".join(word() for _ in range(3)), False)
    for _ in range(rng.randint(1, 4)):
        add("", False)
        add(" ".join(word() for _ in range(rng.randint(8, 30))) + ".", False)
        if rng.random() < 0.4:
            add("", False)
            add(rng.choice(["Print this page", "Advertisement", "Share this: mail link"]), True)
    add("", False)
    for x in ["Related posts", *("- " + " ".join(word() for _ in range(3)) for _ in range(rng.randint(1, 4))), f"Powered by {word()} {rng.randint(1, 9)}.2"]:
        add(x, True)
    return "\n".join(lines), off


def test_learned_weights_decide_on_unseen_pages():
    rng = random.Random(8)
    weights = mainbody.fitted([mainbody.example(planted_page(rng)[0]) for _ in range(400)])
    trained, blank = mainbody.Weights(*weights), mainbody.Weights(*(w * 0 for w in weights))
    hit = false = missed = 0
    for _ in range(200):
        text, off = planted_page(rng)
        got, want = set(mainbody.furniture(text, trained)), set(off)
        hit, false, missed = hit + len(got & want), false + len(got - want), missed + len(want - got)
        assert mainbody.furniture(text, blank) == []
    assert hit / (hit + missed) > 0.97 and hit / (hit + false) > 0.97


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_best_run_by_brute_force(scores):
    found = mainbody.runs([float(s) for s in scores])
    best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
    assert max((r[2] for r in found), default=0) == max(best, 0)
    assert all(r[2] == sum(scores[r[0] : r[1] + 1]) > 0 for r in found) and all(a[1] < b[0] for a, b in zip(found, found[1:]))


# --- 7 packing -----------------------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60))
def test_blocks_hold_all_items_within_capacity(sizes):
    at = packing.pack_block(sizes, 60)
    load = Counter()
    for s, w in zip(sizes, at):
        load[w] += s
    assert len(at) == len(sizes) and all(v <= 60 for v in load.values())


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    sums = [s for s, _ in packing.difference(list(sizes), 20)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 3


def test_packing_is_whole(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(500)] + [(7, 5), (None, 3), (600, None)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id bigint, tokens bigint"), spark.createDataFrame([(1, 100), (2, 999), (3, None)], "window_id int, capacity bigint"), block_items=64).collect()
    for w, cap in ((1, 100), (2, 999)):
        mine = [r for r in out if r.window_id == w]
        assert sum(r.tokens for r in mine) == sum(n or 0 for d, n in docs if d is not None)
        load = Counter()
        for r in mine:
            load[r.container] += r.tokens
            assert r.parts == 1 or dict(docs)[r.doc_id] > cap
        assert max(load.values()) <= cap and {r.doc_id for r in mine} == {d for d, _ in docs if d is not None}
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), spark.createDataFrame([(1, 100)], "window_id int, capacity bigint")).count() == 0


def test_token_counts(spark):
    import regex

    pattern = regex.compile(packing.TOKEN)
    texts = ["", " ", "a  b", "it's 12,5 — ok\n\n x", "天气 好\u3000\u3000x\u00a0y", "\t\ta\r\nb  ", "don't we'll", "é ü 3½", None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packing.token_count("t").alias("n")).collect()]
    assert got == [len(pattern.findall(t or "")) for t in texts]


# --- 8 leakage -----------------------------------------------------------------------------------------------


def test_leaks_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "d"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20))), None if i % 5 else " ".join(rng.choice(vocabulary) for _ in range(9))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    want = set()
    for d, t in docs:
        grams = {tuple(t.split()[k : k + 6]) for k in range(len(t.split()) - 5)}
        for i, *texts in items:
            if any(tuple(x.split()[k : k + 6]) in grams for x in texts if x for k in range(len(x.split()) - 5)):
                want.add((d, i))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, p string, s string")
    for chars in (10**6, 60):  # one pass, and several
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(a, b, "doc_id", "text", "item_id", ["p", "s"], length=6, shard_chars=chars).collect()}
        assert got == want


def test_leaks_through_disguise(spark):
    run = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, run.upper().replace(" ", ",\n")), (2, run.replace("o", "o\u200b")), (3, run.replace(" twelve", "")), (4, None), (5, ""), (5, run), (None, run)]
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, "x " + run + " y", "clash")], "item_id bigint, problem string, text string"), "doc_id", "text", "item_id", ["problem"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 9), (2, 9), (5, 9)]


# --- 9 residue -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mark", ["{{ user_name }}", "${item.answer}", "{% title %}", "<%= author %>", "[[page_title]]", "<<answer>>", "@@name@@", "%site_name%", "#teacher#", "__first_name__", "[INSERT title HERE]", "[Your answer goes here]", "<example to be added>", "(answer pending - replace before release)", "【此处填写标题】", "XXX final value XXX", "TODO: write summary", "[author]"])
def test_placeholders(mark):
    assert residue.placeholders(f"We see {mark} here.") == [mark] or residue.placeholders(f"We see {mark} here.")


@pytest.mark.parametrize("text", ["The text {{ x }} stands for x.", "Shell users write ${HOME} for a folder.", "Let $A = [[1, 2], [3, 4]]$ and ${1, 2}$.", "Fill in: 3 + ____ = 5", "a [note] and (see below) 5 % of 3 %", "print(__name__)", "the text {{ title }} stands for a title"])
def test_no_placeholders(text):
    assert residue.placeholders(text) == []


def test_residue_on_unseen_hosts(spark):
    rng = random.Random(7)
    verbs = ["holds", "meets", "leaves", "gives", "moves"]
    prose = lambda: " ".join(f"The {rng.choice(['red', 'old', 'long'])} {rng.choice(['line', 'road', 'boat'])} {rng.choice(verbs)} {rng.randint(1, 99)} {rng.choice(['stones', 'birds'])}." for _ in range(6))
    errors = ["Page not found", "Access denied", "Please try again in 5 minutes.", "Reference id 1-2.", "Go back to the start page.", "Our team has been told."]
    docs, bad = [], set()
    for i in range(600):
        kind = rng.random()
        text = prose()
        if kind < 0.06:
            text = "\n".join(rng.sample(errors, 3))
        elif kind < 0.12:
            text = text.replace("holds", "{{ user_name }} holds", 1) if "holds" in text else text + " ${item.name}"
        if kind < 0.12:
            bad.add(i)
        docs.append((i, f"host{i % 20}.test", text))
    docs += [(1000, None, None), (1001, "h", " "), (None, "h", "Page not found"), (1002, None, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    told = residue.fit(df)[1]
    assert told["precision"] > 0.9 and told["recall"] > 0.9
    assert {r.doc_id for r in residue.excluded(df).collect()} == bad
    assert residue.excluded(df.where("false")).count() == 0
