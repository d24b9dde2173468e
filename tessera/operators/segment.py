"""Documents cut into segments: at blank lines and headings, short blocks joined, long blocks split."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.features import Rules

BLANK = re.compile(r"\n\s*\n")
HEADING = re.compile(r"#{1,6}\s+.+")
SENTENCE_END = re.compile(r"[.。!！?？]\s+")
DISPLAY = re.compile(r"\$\$.*?\$\$", re.S)
ENVIRONMENT = re.compile(r"\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S)


def joined(blocks: list[str], least: int, most: int) -> list[str]:
    """Neighbours joined while one of them is shorter than ``least`` and both fit into ``most``.

    A pair that was left apart stays so when its members grow, so one pass is enough.
    """
    out: list[str] = []
    for b in blocks:
        if out and min(len(out[-1]), len(b)) < least and len(out[-1]) + len(b) + 2 <= most:
            out[-1] += "\n\n" + b
        else:
            out.append(b)
    return out


def formula_spans(text: str) -> list[tuple[int, int]]:
    """Displayed formulas and environments as disjoint intervals."""
    out: list[list[int]] = []
    for a, b in sorted(m.span() for m in chain(DISPLAY.finditer(text), ENVIRONMENT.finditer(text))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_at(text: str, ends: re.Pattern, spans: list[tuple[int, int]], ideal: int) -> int:
    """Where to cut: the first end beyond 70 % of the ideal length, else the last beyond half of it; -1 if none."""
    best = -1
    for m in ends.finditer(text):
        if m.end() >= ideal // 2 and not any(a <= m.start() < b for a, b in spans):
            best = m.end()
            if best >= ideal * 0.7:
                break
    return best


def split_long(block: str, hard: int, ideal: int) -> list[str]:
    """Pieces of at most ``hard`` characters, cut at blank lines, else sentence ends, else hard.

    Formula intervals move by the length cut off, not by the white space stripped after a cut.
    """
    spans, out = formula_spans(block), []
    while len(block) > hard:
        head = block[:hard]
        at = cut_at(head, BLANK, spans, ideal)
        if at < ideal // 2:
            at = max(at, cut_at(head, SENTENCE_END, spans, ideal)) if at < 0 else cut_at(head, SENTENCE_END, spans, ideal)
        if at < ideal // 3:
            at = hard
        out.append(block[:at].strip())
        block = block[at:].strip()
        spans = [(a - at, b - at) for a, b in spans if b > at]
    return [x for x in [*out, block.strip()] if x]


def segments(text: str | None, r: Rules = Rules()) -> list[str]:
    """The segments of a text in order; none for null and blank texts."""
    blocks: list[str] = []
    for part in BLANK.split((text or "").strip()):
        held: list[str] = []
        for line in part.strip().split("\n"):
            if held and HEADING.match(line):
                blocks.append("\n".join(held).strip())
                held = []
            held.append(line)
        blocks.append("\n".join(held).strip())
    blocks = joined([b for b in blocks if b], r.ideal_min_chars, r.hard_max_chars)
    pieces = [p for b in blocks for p in (split_long(b, r.hard_max_chars, r.ideal_max_chars) if len(b) > r.hard_max_chars else [b])]
    return joined(pieces, r.min_segment_chars, r.hard_max_chars)


def segment_documents(docs: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(doc_id, segment_id, pos, text, char_len) for documents (id, text); ids are cast to string.

    Null ids give no row.
    """

    def scan(ids: list, texts: list) -> list[tuple]:
        return [(d, f"{d}_seg_{i:04d}", i, s, len(s)) for d, t in zip(ids, texts) for i, s in enumerate(segments(t, r))]

    slim = docs.select(F.col("id").cast("string").alias("id"), "text").where("id is not null and text is not null")
    return map_columns(slim, scan, "doc_id string, segment_id string, pos int, text string, char_len int")
