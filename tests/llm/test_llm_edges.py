"""Every operator on training text over nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import leakage, mainbody, markup, packing, pairs, quality, quota_sample, repetition, residue

LONG = "We add the numbers and find the area of the curve, which is what the proof needs.\n" * 4_000  # about a third of a million characters
HOSTILE = ("<!-- " + "[" * 50 + "$ \\( ** __ {{ ") * 500
TEXTS = [None, "", " \n\t ", "x", "​", LONG, HOSTILE, "One line.", "One line."]
#: Names that the operators use within.
CLASHES = ["_shard", "lang", "kind", "share", "tokens", "body", "item", "block", "label", "reason", "defect", "markup", "notations", "furniture", "line_no", "container", "n", "p", "hash", "count"]

OPERATORS = {
    "repeated": (lambda d: repetition.repeated(d), "rec_table string, rec_key string, text string", "rec_key"),
    "perplexity": (lambda d: repetition.perplexity(d), "rec_table string, rec_key string, text string", "rec_key"),
    "not_prose": (lambda d: quality.not_prose(d), "id string, text string", "id"),
    "kinds": (lambda d: quality.kinds(d), "id string, text string", "id"),
    "placed": (lambda d: quality.placed(quality.measured(d)), "id string, text string", "id"),
    "residue": (lambda d: markup.residue(d), "rec_table string, rec_key string, text string", "rec_key"),
    "cleaned": (lambda d: markup.cleaned(d), "rec_table string, rec_key string, text string", "rec_key"),
    "defects": (lambda d: pairs.defects(d.withColumn("question", F.lit("How many are there?")).withColumnRenamed("text", "continuation")), "gen_id string, text string", "gen_id"),
    "bodies": (lambda d: mainbody.bodies(d), "id string, text string", "id"),
    "furniture_lines": (lambda d: mainbody.furniture_lines(d), "id string, text string", "id"),
    "pack": (lambda d: packing.pack(d.select("doc_id", packing.token_count("text").alias("tokens")), d.sparkSession.createDataFrame([(1, 512)], "window_id int, capacity int")), "doc_id string, text string", "doc_id"),
    "leaks": (lambda d: leakage.leaks(d, d.sparkSession.createDataFrame([(1, "We add the numbers and find the area of the curve, which is what"), (2, None), (3, "")], "item_id int, problem string"), "doc_id", "text", "item_id", ["problem"]), "doc_id string, text string", "doc_id"),
    "excluded": (lambda d: residue.excluded(d), "doc_id string, source string, text string", "doc_id"),
}
#: Rows that must come out, by operator: keys of the rows of TEXTS.
FOUND = {"repeated": {"5"}, "cleaned": {"3", "4", "5", "6", "7", "8"}, "bodies": {"1", "2", "3", "4", "5", "6", "7", "8"}, "leaks": {"5"}, "furniture_lines": set()}


def rows(shape: str) -> list[tuple]:
    extra = shape.count(",") - 1
    return [*((*("t",) * extra, str(i), t) if "rec_table" in shape else (str(i), *("t",) * extra, t) for i, t in enumerate(TEXTS)), *([("t", None, "One line.")] if "rec_table" in shape else [(None, *("t",) * extra, "One line.")])]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    operator, shape, key = OPERATORS[name]
    df = spark.createDataFrame(rows(shape), shape)
    plain = sorted(map(str, operator(df.repartition(3)).collect()))
    keys = {r[key] for r in operator(df).collect()}
    assert None not in keys and keys <= {str(i) for i in range(len(TEXTS))} and keys == FOUND.get(name, keys)
    clashing = df.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in df.columns))
    assert sorted(map(str, operator(clashing).collect())) == plain  # extra columns change nothing
    assert operator(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["repeated", "not_prose", "residue", "defects", "furniture_lines", "leaks", "excluded"])
def test_repeated_rows_give_no_repeated_rows(spark, name):
    operator, shape, _ = OPERATORS[name]
    df = spark.createDataFrame(rows(shape) * 3, shape)
    got = [tuple(r) for r in operator(df).collect()]
    assert len(got) == len(set(got))


def test_quotas_with_nulls_and_clashes(spark):
    plans = spark.createDataFrame([(1, 1, "a", None, None, None, 4, "x"), (1, 2, None, "B", 0.5, 1, None, "x"), (None, 3, "c", "c", 0.5, 1, 4, "x"), (2, 1, "a", "a", 1.0, 0, 0, "x")], "plan_id int, category_id int, category string, name_en string, target_share double, min_rows int, sample_rows int, drawn string")
    held = quota_sample.available(spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 0, "x"), (2, "b", None, "x"), (None, "a", 1, "x"), (3, None, 1, "x")], "id bigint, category string, band int, targets string"), plans)
    told = quota_sample.report(held, plans)
    assert {(r.plan_id, r.category_id): r.available for r in told.collect()} == {(1, 1): 1, (1, 2): 1, (2, 1): 1}
    drawn = [tuple(r) for r in quota_sample.draw(held, told).collect()]
    assert len(drawn) == len(set(drawn)) and {d[2] for d in drawn} <= {1, 2}
