"""Question and answer pairs out of marked-up samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.answers import reference_from_solution, with_box
from tessera.functions.arrow import map_columns

MARK = re.compile(r"\*\*(Question|Answer|Code Implementation) (\d+)\*\*:\s*\n?")
QUESTION = re.compile(r"\*\*Question\s+(\d+)\*\*:\s*")


def sections(text: str) -> list[tuple[int, str, str, str]]:
    """(number, question, answer, code) by number; of repeated marks the last counts, a section ends at the next mark.

    An answer ends at its own code section where there is one. Numbers without question or answer give nothing.
    """
    marks = [(m[1], int(m[2]), m.start(), m.end()) for m in MARK.finditer(text)]
    starts = sorted(m[2] for m in marks)
    last = {(kind, n): (a, b) for kind, n, a, b in marks}

    def until(a: int) -> int:
        return next((s for s in starts if s > a), len(text))

    out = []
    for n in sorted({m[1] for m in marks}):
        q, a, c = (last.get((k, n)) for k in ("Question", "Answer", "Code Implementation"))
        if q and a:
            code = text[c[1] : until(c[0])].strip() if c else ""
            out.append((n, text[q[1] : a[0]].strip(), text[a[1] : c[0] if c else until(a[0])].strip(), code))
    return out


def extracted(samples: DataFrame) -> DataFrame:
    """(source_file, source_idx, question_idx, question, answer, code, ground_truth, gt_source) of samples (source_file, source_idx, text).

    Questions below 10 and answers below 20 characters are left out, and so are null texts.
    """

    def scan(files: list, rows: list, texts: list) -> list[tuple]:
        return [(f, i, *s) for f, i, t in zip(files, rows, texts) if t for s in sections(t)]

    slim = samples.select(F.col("source_file").cast("string").alias("source_file"), F.col("source_idx").cast("long").alias("source_idx"), "text")
    df = map_columns(slim, scan, "source_file string, source_idx bigint, question_idx int, question string, answer string, code string")
    return df.where("length(question) >= 10 and length(answer) >= 20").withColumn("gt", reference_from_solution("answer", "code")).select(*df.columns, "gt.ground_truth", "gt.gt_source")


def qa_pairs(text: str) -> list[tuple[str, str]]:
    """Questions with the answers of their own number, read in order; empty ones are left out."""
    found = list(QUESTION.finditer(text))
    out = []
    for i, m in enumerate(found):
        a = re.compile(rf"\*\*Answer\s+{m[1]}\*\*:\s*").search(text, m.end())
        if not a:
            continue
        c = re.compile(rf"\*\*Code Implementation\s+{m[1]}\*\*:\s*").search(text, a.end())
        end = c.start() if c else found[i + 1].start() if i + 1 < len(found) else len(text)
        answer = re.sub(r"(?s)\*\*Question\s+\d+\*\*:.*$", "", text[a.end() : max(end, a.end())].strip()).strip()
        if (q := text[m.end() : a.start()].strip()) and answer:
            out.append((q, answer))
    return out


def sft_pairs(samples: DataFrame, most: int | None = None) -> DataFrame:
    """(source_file, source_idx, pos, question, answer) with boxed answers, in file order up to ``most`` rows."""

    def scan(files: list, rows: list, texts: list) -> list[tuple]:
        return [(f, i, k, q, a) for f, i, t in zip(files, rows, texts) if t for k, (q, a) in enumerate(qa_pairs(t))]

    slim = samples.select(F.col("source_file").cast("string").alias("source_file"), F.col("source_idx").cast("long").alias("source_idx"), "text")
    df = map_columns(slim, scan, "source_file string, source_idx bigint, pos int, question string, answer string").withColumn("answer", with_box("answer"))
    return df if most is None else df.orderBy("source_file", "source_idx", "pos").limit(most)
