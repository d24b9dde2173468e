"""Per-document statistics, their distributions per language, and documents that are no prose in the main.

Statistics of words, lines and symbols are sketched per language with mergeable quantile sketches. A value
becomes a percentile and a robust z-score of its language. A document is a list, table or junk if its share of
items, table rows or unreadable characters lies in the upper tail of the language's running prose, by sketches
over the documents that are prose in the main, so that the tail does not move however many lists there are.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.words import HAN, visible
from tessera.llm.mainbody import COUNTER, sentence, tagged
from tessera.llm.pairs import STOPWORDS, leading, votes
from tessera.sources.tables import spread, written

SHARES = ("list", "table", "junk")
STATS = ("n_chars", "n_words", "word_length", "symbol_ratio", "digit_ratio", "ending_lines", "common_words", "short_lines", *(f"{k}_share" for k in SHARES))
#: A share in the main; the least spread that a z-score is taken over; the least documents of a language with a sketch of its own.
MAIN, SPREAD, OWN = 0.5, 0.1, 50
#: A tail begins at this z-score among prose, over at least this spread, and no nearer to 1 than half way from this percentile.
TAIL, TAIL_SPREAD, TOP = 3.5, 0.2, 0.995

#: Votes for a language, as a part of the words, from which a text counts to it.
VOTED = 0.08

FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$|<math>.*?</math>", re.S)
MARK = re.compile(r"^\s*(?:[-*•·»–▪◦‣](?=\s|$)|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]+)[.)](?=\s|$)|[（(][一二三四五六七八九十\d]+[)）]|<li>|\\item)\s*")
CODE = re.compile(r"^\s*(?:```|def .*:$|for .*:$|if .*:$|while .*:$|else:$|return\b|print\(|\w+ [-+*/]?= |</?(?:pre|code|syntaxhighlight)|\\(?:begin|end)\{|</?(?:ul|ol)>)")
SEPARATORS = (("\t", re.compile(r"\t")), ("|", re.compile(r"\s*\|\s*")), (";", re.compile(r"\s*[;；]\s*")), (",", re.compile(r"\s*,\s*")), (" ", re.compile(r"\s{2,}")), ("&", re.compile(r"\s+&\s+")))
SPLIT = dict(SEPARATORS)
ELEMENT = re.compile(r"</?[a-zA-Z][^<>]*>")
LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\s,;|]+")
VOWEL = re.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõøùúûüœ]", re.I)
CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxz]{6,}", re.I)
COMMON = frozenset(w for ws in STOPWORDS.values() for w in ws)


def cells(line: str) -> tuple[str, int] | None:
    """Separator and number of cells of a line that could be a table's row."""
    if sentence(line) and "\t" not in line and "|" not in line:
        return None
    body = line.rstrip(" \r\n")
    if body.startswith("|") and body.endswith("|"):
        body = body[1:-1]
    for name, sep in SEPARATORS:
        parts = sep.split(body.strip() if name == " " else body)
        if name == " " and any(not p for p in parts):
            continue
        if len(parts) >= 3 and max(map(len, parts)) <= 40 and sum(map(len, parts)) <= 20 * len(parts):
            return name, len(parts)
    return None


@lru_cache(maxsize=1 << 16)
def unreadable(token: str) -> bool:
    """Whether a token is no word, number or name of any language: by script, vowels, length and mixture."""
    if len(set(token)) == 1:
        return False
    core = token.strip(".,;:!?()[]{}\"'“”‘’«»„…—–-、。，；：！？（）《》")
    if not core:
        return len(token) > 3
    letters = LETTERS.findall(core)
    size = sum(map(len, letters))
    if not size:
        return not re.fullmatch(r"[.·…_=~*-]+", core) and not re.fullmatch(r"[-+±]?[\d.,:/%°$€£×=+*^<>≤≥-]{1,24}", core) and len(core) > 2
    if size < 0.5 * len(core) and len(core) > 6 and not core.startswith("\\"):
        return True
    word = "".join(letters)
    if HAN.search(core):
        return False
    low = sum(1 for c in word if "\u0080" <= c <= "ÿ" or c in "œŒ€‚")
    if low > 0.5 * len(word) and len(word) >= 2:
        return True
    if not word.isascii() and any(ord(c) > 0x24F for c in word):
        return any(ord(c) < 0x250 for c in word) and len(word) > 3
    if len(word) > 24 and "-" not in core and "/" not in core and "." not in core:
        return True
    if len(core) > 24 and re.search(r"[a-z]", core) and re.search(r"[A-Z0-9]", core) and not core.startswith(("http", "\\", "<")):
        return True
    if re.search(r"[|]", core) or (re.search(r"[a-z]\d[a-z]", core) and "_" not in core):
        return True
    longest = max(letters, key=len)
    if len(longest) >= 3 and not VOWEL.search(longest) and not longest.isupper():
        return True
    return bool(CLUSTER.search(longest)) or (len(longest) > 4 and bool(re.search(r"[a-z][A-Z][a-z]*[A-Z]|[a-z]{2}[A-Z]$", longest)))


def vowel_poor(line: str) -> bool:
    """Whether a line's Latin letters are too many to hold so few vowels: random letters, however short the tokens."""
    latin = re.sub(r"[^a-z]", "", re.sub(r"\\[a-zA-Z]+", "", line).lower()) if line.isascii() else ""
    return len(latin) >= 15 and sum(map(latin.count, "aeiouy")) < 0.2 * len(latin)


HEX = re.compile(r"[0-9a-f]{2,8}|[0-9A-F]{2,8}")


def encoded(tokens: list[str]) -> bool:
    """Whether a line is a dump of bytes: many hexadecimal tokens of one length, digits and letters mixed."""
    return len(tokens) > 5 and len(set(map(len, tokens))) == 1 and all(map(HEX.fullmatch, tokens)) and not all(map(str.isdigit, tokens)) and not all(map(str.isalpha, tokens))


def size(line: str) -> int:
    """Characters that show, without tags; a Han character counts as three, as it says about as much."""
    bare = ELEMENT.sub("", line) if "<" in line else line
    return len(bare) - sum(map(bare.count, " \t\u3000\u00a0")) + (0 if bare.isascii() else 2 * len(HAN.findall(bare)))


def content(text: str) -> dict[str, int]:
    """Sizes of a text's list items, table rows, unreadable and running lines, in characters that show.

    Formula lines, code and page furniture with its links count for nothing. Three or more neighbouring lines
    of as many short cells are a table. Lines of a wrapped paragraph are running text. An item that comes again
    counts once: repetition is no list.
    """
    out = dict.fromkeys(("list", "table", "junk", "prose"), 0)
    seen: set[str] = set()
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line)
            continue
        if block:
            weigh(block, out, seen)
        block = []
    return out


#: Longest line that can be furniture; a line reads as language if every so many words is a common one.
TAG_CHARS, READS = 240, 5
STOP = re.compile(r"[.!?。！？](?=\s|$)|[。！？]")
RUNS_ON = re.compile(r"\s*[a-zà-ÿа-я$\d(]")


class Line:
    """What a line shows by itself."""

    __slots__ = ("bare", "code", "counter", "furniture", "garbled", "item", "row", "said", "size", "tokens", "units")

    def __init__(self, line: str) -> None:
        self.size = size(line)
        self.bare = FORMULA.sub(" ", line) if "$" in line or "<math>" in line else line
        self.code = bool(CODE.match(line))
        self.tokens = self.bare.split()
        self.garbled = False
        if not (self.code or len(self.tokens) > 7 and sum(map(COMMON.__contains__, self.tokens)) * READS >= len(self.tokens)):
            self.tokens = TOKEN.findall(self.bare)
            bad = sum(map(len, filter(unreadable, self.tokens)))
            shown = self.size if self.bare is line else size(self.bare)
            self.garbled = (bad > 0.5 * shown and shown > 3) or vowel_poor(self.bare) or encoded(self.tokens)
        self.item = (m := MARK.match(line)) is not None
        rest = line[m.end() :] if m else line
        self.said = sentence(rest)
        self.row = None if len(line) < 5 or ((sentence(line) if m else self.said) and "\t" not in line and "|" not in line) else cells(line)
        self.furniture = len(line) <= TAG_CHARS and tagged(line)
        self.units = self.counter = None
        if not self.said or self.item:
            self.units = len(LETTERS.findall(HAN.sub(" ", FORMULA.sub(" x ", rest)))) + len(HAN.findall(rest)) / 2
            self.counter = bool(COUNTER.search(line))


short_line = lru_cache(maxsize=1 << 15)(Line)


def weigh(block: list[str], out: dict[str, int], seen: set[str]) -> None:
    facts = [short_line(x) if len(x) <= 60 else Line(x) for x in block]
    table = [False] * len(block)
    i = 0
    while i < len(block):
        row, j, full = facts[i].row, i + 1, 1
        while row and j < len(block):
            r = facts[j].row
            if r and r[0] == row[0] and abs(r[1] - row[1]) <= 1:
                full += 1
            elif r or facts[j].said or not SPLIT[row[0]].search(block[j].strip()):
                break  # a row with empty cells is still a row
            j += 1
        if full >= 3:
            table[i:j] = [True] * (j - i)
            if i and facts[i - 1].furniture and facts[i - 1].row:
                table[i - 1] = True
        i = j
    flows = wrapped(block, facts, table)
    chrome = False
    tags = any(f.furniture for f in facts)
    for i, f in enumerate(facts):
        if f.garbled:
            out["junk"] += f.size
        elif table[i]:
            out["table"] += f.size
        elif f.furniture:
            chrome = True
        elif f.code:
            continue
        elif f.said and (not f.item or f.units > 12):
            out["prose"] += f.size
        elif not f.tokens or (not f.item and not f.bare.strip(" .,;:")):
            continue  # a formula of its own
        elif not f.item and flows[i]:
            out["prose"] += f.size
        elif f.counter and not f.item and chrome:
            continue
        elif f.units > 14:
            out["prose"] += f.size
        elif not (chrome or tags or (line := block[i].strip()) in seen):
            seen.add(line)
            out["list"] += f.size


def wrapped(block: list[str], facts: list[Line], table: list[bool]) -> list[bool]:
    """Which lines stand in a paragraph of hard line breaks: their neighbours run on and sentences end there."""
    out = [False] * len(block)
    cut = [t or f.furniture or f.item for t, f in zip(table, facts)]
    a = 0
    for b in range(1, len(block) + 1):
        if b < len(block) and not cut[b]:
            continue
        first = a + cut[a]  # an item or a table's row ends before the paragraph
        if b - first > 1:
            lines = block[first:b]
            ends = sum(len(STOP.findall(FORMULA.sub("x", x) if "$" in x else x)) for x in lines)
            starts = sum(map(bool, map(RUNS_ON.match, lines[1:])))
            if ends * 8 >= len(lines) and (starts * 3 >= len(lines) - 1 or HAN.search("".join(lines))):
                out[first:b] = [True] * (b - first)
        a = b
    return out


def shares(t: str) -> tuple:
    """(language, list, table and junk share) of a visible text; shares are of its list, table, junk and prose."""
    parts = content(t)
    whole = sum(parts.values())
    told, total = votes(t)
    lang, sure = leading(told, total)
    known = sure >= 0.5 and total >= 3 and (total >= VOTED * (len(t) / 2 + 1) or total >= VOTED * (len(LETTERS.findall(HAN.sub(" ", t))) + len(HAN.findall(t)) / 2))
    return lang if known else "und", *(parts[k] / whole if whole else 0.0 for k in SHARES)


def statistics(text: str) -> tuple:
    """(language, values of STATS) of a text."""
    t = visible(text)
    lines = [x for x in t.split("\n") if x.strip()]
    words = LETTERS.findall(HAN.sub(" ", t))
    han = len(HAN.findall(t))
    n = sum(map(len, t.split())) or 1
    symbols = n - sum(map(str.isalnum, t))
    digits = sum(map(str.isdigit, t))
    ending = sum(1 for x in lines if re.search(r"[.!?。！？:：;；…][\"'”’)\]]*\s*$", x))
    lang, *parts = shares(t)
    return (
        lang, float(len(t)), float(len(words) + han / 2), sum(map(len, words)) / len(words) if words else 0.0, symbols / n, digits / n, ending / (len(lines) or 1),
        sum(map(COMMON.__contains__, map(str.lower, words))) / (len(words) or 1), sum(1 for x in lines if len(x) < 40) / (len(lines) or 1), *parts,
    )


SCHEMA = "id string, lang string, " + ", ".join(f"{s} double" for s in STATS)


def measured(pages: DataFrame) -> DataFrame:
    """(id, lang, statistics) for pages (id, text). Null ids, null and blank texts give no row."""

    def scan(ids: list, texts: list) -> list[tuple]:
        return [(i, *statistics(t)) for i, t in zip(ids, texts)]

    return map_columns(spread(pages.select("id", "text").where(r"id is not null and text rlike '\\S'")), scan, SCHEMA)


def sketches(stats: DataFrame, names: tuple = STATS) -> DataFrame:
    """(lang, n, one sketch per statistic); lang null is the merge of all languages."""
    each = stats.groupBy("lang").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c).alias(c) for c in names))
    return each.unionByName(each.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(c).alias(c) for c in names)).where("n is not null").select(F.lit(None).cast("string").alias("lang"), "n", *names))


def placed(stats: DataFrame, names: tuple = STATS, own: int = OWN) -> DataFrame:
    """``stats`` with the percentile (<name>_pct) and robust z-score (<name>_z) of each statistic in its language.

    A z-score is the distance from the median over 0.7413 times the interquartile range, which is at least
    SPREAD; <name>_z_all is the same among all documents. Languages of fewer than ``own`` documents, and text
    of no language, are placed among all documents.
    """
    ranks = F.array(*(F.lit(i / 100) for i in range(101)))
    told = sketches(stats, names).select("lang", "n", *(F.kll_sketch_get_quantile_double(F.col(c), ranks).alias(f"{c}_at") for c in names))
    rows = told.collect()  # one row per language that `language` knows
    known = sorted(r.lang for r in rows if r.lang and r.lang != "und" and r.n >= own)
    local = [("*" if r.lang is None else r.lang, *(r[f"{c}_at"] for c in names)) for r in rows if r.lang is None or r.lang in known]
    right = stats.sparkSession.createDataFrame(local, "_group string, " + ", ".join(f"{c}_at array<double>" for c in names))
    right = right.select("*", *(F.get(f"{c}_at", F.lit(i)).alias(f"{c}_{k}") for c in names for k, i in (("lo", 25), ("mid", 50), ("hi", 75))))
    group = F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit("*")) if known else F.lit("*")
    joined = stats.withColumn("_group", group).join(F.broadcast(right), "_group")

    def z(c: str) -> Column:
        return (F.col(c) - F.col(f"{c}_mid")) / (F.lit(0.7413) * F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(SPREAD)))

    every = next((r for r in rows if r.lang is None), None)

    def z_all(c: str) -> Column:
        at = every[f"{c}_at"] if every else [0.0] * 101
        return (F.col(c) - at[50]) / (0.7413 * max(at[75] - at[25], SPREAD))

    def percentile(c: str) -> Column:
        return F.greatest(F.size(F.filter(f"{c}_at", lambda q: q <= F.col(c))) - 1, F.lit(0)) / 100

    return joined.select(*stats.columns, *(percentile(c).alias(f"{c}_pct") for c in names), *(z(c).alias(f"{c}_z") for c in names), *(z_all(c).alias(f"{c}_z_all") for c in names))


def tails(stats: DataFrame, own: int = OWN) -> dict[str | None, dict[str, float]]:
    """Where the upper tail of each share begins, by language; None for all languages together.

    Sketched are the documents that are prose in the main; a language of fewer than ``own`` of them has no entry.
    A tail begins TAIL robust z-scores above the median, or half way between the TOP percentile and 1 if that is less.
    """
    names = tuple(f"{k}_share" for k in SHARES)
    prose = stats.where(sum((F.col(c) for c in names), F.lit(0.0)) <= MAIN)
    at = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75, TOP)))
    told = sketches(prose, names).select("lang", "n", *(F.kll_sketch_get_quantile_double(F.col(c), at).alias(c) for c in names)).collect()  # one row per language

    def begin(lo: float, mid: float, hi: float, top: float) -> float:
        return min(mid + TAIL * 0.7413 * max(hi - lo, TAIL_SPREAD), (top + 1) / 2)

    return {None: dict.fromkeys(SHARES, MAIN)} | {r.lang: {k: begin(*r[c]) for k, c in zip(SHARES, names)} for r in told if r.lang is None or (r.lang != "und" and r.n >= own)}


def kind(begins: dict[str | None, dict[str, float]]) -> Column:
    """The largest of the list, table and junk shares that lie in their tails, else null, for prose."""

    def cut(k: str) -> Column:
        out = F.lit(begins[None][k])
        for lang, at in begins.items():
            if lang is not None:
                out = F.when(F.col("lang") == lang, F.lit(at[k])).otherwise(out)
        return out

    far = {k: F.when(F.col(f"{k}_share") > cut(k), F.col(f"{k}_share")) for k in SHARES}
    top, found = F.greatest(*far.values()), F.lit(None).cast("string")
    for k in reversed(SHARES):
        found = F.when(far[k] == top, F.lit(k)).otherwise(found)
    return found


def kinds(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(id, lang, statistics, z-scores, kind) for each page; kind is null for prose.

    ``rules`` (id, run_no, feature_dict) adds the latest run's char_len, number_count and symbol_count.
    """
    stats = written(measured(pages), "statistics")
    out = placed(stats, tuple(f"{k}_share" for k in SHARES)).withColumn("kind", kind(tails(stats)))
    if rules is None:
        return out
    last = rules.where("id is not null").groupBy("id").agg(F.max_by("feature_dict", F.coalesce("run_no", F.lit(-1))).alias("f"))
    return out.join(last.select("id", F.col("f.char_len").alias("rule_chars"), F.col("f.number_count").alias("rule_numbers"), F.col("f.symbol_count").alias("rule_symbols")), "id", "left")


def not_prose(pages: DataFrame) -> DataFrame:
    """(id, kind) of pages that are a list, a table or junk in the main, each once.

    Only language and shares are measured. Null ids, null and blank texts give no row.
    """

    def scan(ids: list, texts: list) -> list[tuple]:
        return [(i, *shares(visible(t))) for i, t in zip(ids, texts)]

    slim = "id string, lang string, " + ", ".join(f"{k}_share double" for k in SHARES)
    stats = written(map_columns(spread(pages.select("id", "text").where(r"id is not null and text rlike '\\S'")), scan, slim), "shares")
    return stats.select("id", kind(tails(stats)).alias("kind")).where("kind is not null").distinct()
