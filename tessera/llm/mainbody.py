"""Main body of web pages by maximum-scoring subsequence over lines.

Words score positive and page tags negative, with weights learned from labelled pages: phrases and the layout of
furniture label a bounded sample only. Two logistic models score a line, one by its words and look, one by the
scores and looks around it. One linear scan finds the contiguous region with the largest sum of scores, and the
other runs of positive sum (titles, paragraphs cut off); what scores negative within a run is furniture too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns, map_stream
from tessera.functions.words import HAN
from tessera.sources.tables import spread

#: The sample the weights are fitted on: pages (by hash of the id), lines of a page, features of a line.
FIT_PAGES, FIT_LINES, FIT_FEATURES = 4_000, 300, 300
#: Dimensions of the hashed features of a line, and of its surroundings.
DIMENSIONS, AROUND = 1 << 17, 1 << 16
#: A line's score is at most this far from 0; the least sum of a run beside the best one.
BOUND, LEAST = 6.0, 0.5

# Phrases of page furniture, the weak labels (fixed values): those that open a line, those that stand within it.
OPENING = re.compile(
    r"(?i)^\W*(?:skip to (?:main )?(?:content|navigation)|jump to (?:content|navigation)|back to (?:the )?top|mobile (?:version|site)|desktop version|print(?:able)? (?:this page|version)|print this|share(?: this)?(?: page| post)?\s*(?::.*)?|share on \w+"
    r"|follow us\b.*|terms (?:of (?:use|service)|and conditions)\b.*|privacy(?: policy| notice)?(?:\W.*)?|imprint|sitemap|powered by .*|hosted (?:at|by) .*|(?:page )?generated in .*|version [\d.]+, theme .*"
    r"|(?:copyright|©|\(c\)).*\b(?:19|20)\d\d\b.*|all rights reserved\b.*|was this (?:page |article |answer )?helpful.*|rate this .*|report (?:a problem|this)\b.*|sign (?:up|in)\b.*|log ?in to .*|you must be (?:signed|logged) in\b.*|subscribe\b.*"
    r"|join [\d,.]+ .*|get unlimited .*|continue reading in .*|advertisements?|sponsored(?: content| links?)?|newsletter|related (?:questions|posts|articles|links|topics|pages)|you may also like|recent (?:posts|articles|comments|questions)|popular (?:this week|posts|articles|now)|hot (?:topics|questions)"
    r"|latest (?:posts|articles|news)|trending(?: now)?|categories|archives|tags|blogroll|[\d,.]+ (?:comments?|likes?|views?|replies|shares)\b(?:,.*)?|posted (?:by|in|on) .*|filed under .*|leave a (?:comment|reply)|(?:previous|next) (?:post|page|article))\W*$"
    r"|^\W*(?:跳到正文|跳至内容|返回顶部|回到顶部|广告|推广|赞助内容|热门推荐|最新文章|相关题目|相关文章|相关推荐|猜你喜欢|友情链接.*|热门文章|热门话题|手机版|电脑版|打印本页|分享到[:：].*|备案号.*|版权所有.*|使用条款.*|隐私政策.*|联系客服|登录后.*|请先?登录.*|注册后.*|阅读\s*\d+\s*次.*|下载客户端.*|下载APP.*|扫码.*|关注我们.*|页面生成.*|评论\s*\d+.*|本站使用Cookie.*)\W*$"
)
WITHIN = re.compile(
    r"(?i).* [-–] [\d,.]+ views?\W*$|.* is run by volunteers since |.*\b(?:uses?|stores?|set) (?:\w+ ){0,3}(?:cookies|tracking pixels|small text files|similar storage)\b|.*\b(?:accept all|by continuing you agree|read our privacy notice|cookie settings|manage cookies)\b"
    r"|.*\s*[-–]?\s*\d+\s*次(?:浏览|阅读)\W*$|.*ICP备|.*(?:接受|同意)(?:隐私|Cookie)|.*继续访问即表示同意|.*存储少量信息|.*Cookie以改善"
)
#: Letters without which nothing of WITHIN can match (lower case).
HINTS = ("view", "volunteers", "cookie", "pixels", "text files", "storage", "accept all", "agree", "privacy", "次", "icp", "同意", "接受", "信息")
CRUMBS = re.compile(r"^\s*[^\s>»/:|›→][^>»/:|›→]{0,40}(?:\s(?:>|»|/|::|›|→)\s[^>»/:|›→.]{1,40}){1,6}\s*$")
CELLS = re.compile(r"\s+[|·•]\s+|\s{2,}|\t")
ENDS = re.compile(r"[.!?。！？：:;；…][\"'”’)\]]*\s*$")
COUNTER = re.compile(r"(?:\(\d+\)|[-–] [\d,.]+ (?:views?|replies|comments?))\s*$")
WORD = re.compile(r"[^\W\d_]+")


def menu_row(line: str) -> bool:
    """Whether the line is a row of at least four short links without numbers, formulas or an end mark."""
    cells = [c for c in CELLS.split(line.strip()) if c]
    if len(cells) < 4 and not (len(cells) >= 3 and re.search(r"\s[|·•]\s", line)):
        return False
    return "$" not in line and not ENDS.search(line) and all(len(c) <= 24 and not re.search(r"\d[\d.,]*\d|[=+*{}\\^]", c) and WORD.search(c) for c in cells) and any(" " in c or len(c) > 1 for c in cells)


def sentence(line: str) -> bool:
    """Whether the line reads as text: an end mark after several words, or a long run of words."""
    n = len(HAN.findall(line)) / 2 + len(WORD.findall(re.sub(r"\$[^$]*\$", " x ", line)))
    return (n >= 5 and bool(ENDS.search(line))) or n >= 14


def tagged(line: str) -> bool:
    """Whether a line is furniture by its phrase, as a row of links or as breadcrumbs."""
    low = line.lower()
    if OPENING.match(line) or (any(h in low for h in HINTS) and WITHIN.match(line)) or menu_row(line):
        return True
    return len(line) < 90 and bool(CRUMBS.match(line)) and not re.search(r"[\d$=]{3,}|\$", line)


def label(line: str) -> int:
    """The weak label of a line: 1 body, -1 furniture, 0 undecided."""
    if tagged(line):
        return -1
    return 1 if sentence(line) or re.match(r"\s*(?:\$\$|<math\b|\\begin\{|\\\[|return\b|for .*:$|def .*:$|if .*:$|\w+ \+?= )", line) else 0


def labels(lines: list[str]) -> list[int]:
    """The weak labels of a page's lines; a row of words above rows of as many cells with numbers heads a table."""
    out = [label(x) for x in lines]
    for i, line in enumerate(lines[:-1]):
        below = lines[i + 1].strip()
        if out[i] < 0 and menu_row(line) and re.search(r"\d", below) and abs(len(CELLS.split(below)) - len(CELLS.split(line.strip()))) <= 1:
            out[i] = 0
    return out


def paragraphs(lines: list[str], stop: list[bool]) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of consecutive lines that are neither blank nor stopped."""
    at = None
    for i, x in enumerate([*lines, ""]):
        inside = i < len(lines) and bool(x.strip()) and not stop[i]
        if inside and at is None:
            at = i
        elif not inside and at is not None:
            yield at, i
            at = None


def weak_labels(lines: list[str]) -> list[int]:
    """The training labels of a page's lines: 1 body, -1 furniture, 0 blank or unknown.

    Phrases and layout decide. Undecided lines are body in a block of text, after a blank line, or as one line
    before the text; those right after furniture are its links, and above it, with no blank line between, a menu,
    as are rows of separated words.
    """
    out = labels(lines)
    if min(out, default=0) >= 0:
        return [1 if x.strip() else 0 for x in lines]
    tag = [y < 0 for y in out]
    start = next((i for i, y in enumerate(out) if y > 0), len(out))
    for a, b in paragraphs(lines, tag):
        blank_above, blank_below = a > 0 and not lines[a - 1].strip(), b < len(lines) and not lines[b].strip()
        text = any(y > 0 for y in out[a:b]) or (b - a > 1 and sentence(" ".join(lines[a:b])) and all(len(x) >= 25 for x in lines[a : b - 1]))
        row = any(re.search(r"\s[|·•]\s", x) for x in lines[a:b])
        if text or blank_above or (b - a == 1 and b <= start and blank_below and not row):
            y = 1
        else:
            y = -1 if row or a > start or not blank_below else 0
        for i in range(a, b):
            out[i] = y
    return out


WORDS = re.compile(r"[^\W\d_]+|0|[|»›>©•·]")
DIGITS = re.compile(r"\d[\d.,]*")
ITEM = re.compile(r"[*\-•»›>](?=\s)|\d+[.)](?=\s)|\([a-z]\)(?=\s)")
ENDINGS = frozenset(".!?。！？：:;；…\"”’)]")


def look(line: str) -> str:
    """A stripped line's mark, length, separators, end and signs of mathematics, as one short word."""
    n = line.count(" ") + 1 if line.isascii() else line.count(" ") + len(HAN.findall(line)) // 2
    mark = line[:1] if ITEM.match(line) else ""
    seps = len(CELLS.findall(line)) if n > 1 else 0
    crumbs = sum(map(line.count, (" > ", " » ", " / ", " :: ", " › ", " → "))) if n > 2 else 0
    size = n if n < 4 else 4 + (n > 6) + (n > 10) + (n > 16)
    maths = "$" in line or "\\" in line or "=" in line
    return f"{'1' if mark.isdigit() else mark}{'abcdefgh'[size]}{min(seps, 4)}{min(crumbs, 2)}{'.' if line[-1:] in ENDINGS else ''}{'$' if maths else ''}{'<' if '<' in line else ''}{'0' if line[-1:].isdigit() or line[-2:-1].isdigit() else ''}"


def grams(line: str, seen: str) -> list[str]:
    """Words, marks and pairs of neighbours of a stripped line; Han text by pairs; a short line as a whole."""
    low = DIGITS.sub("0", line.lower())
    ts = WORDS.findall(low)
    if not low.isascii():
        ts = [x for t in ts for x in ((t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 2 and HAN.match(t) else (t,))]
    if len(ts) <= 24:
        ts += list(map(" ".join, zip(ts, ts[1:])))
    if len(low) <= 40:
        ts.append("=" + (low[1:].lstrip() if ITEM.match(low) else low))
    ts.append("<" + seen)
    return ts


class Weights(dict):
    """Hashed weights by feature, with a bounded cache of the features met and of the lines that keep coming."""

    def __init__(self, own: np.ndarray, around: np.ndarray, cached: int = 1 << 19) -> None:
        super().__init__()
        self.own, self.bias, self.cached = own, float(own[-1]), cached
        self.met: dict[str, tuple[float, str]] = {}
        self.near = Around(around, cached)
        self.trained = bool(own.any() and around.any())

    def __missing__(self, gram: str) -> float:
        if len(self) >= self.cached:
            self.clear()
        w = self[gram] = float(self.own[crc32(gram.encode("utf-8", "surrogatepass")) % DIMENSIONS])
        return w

    def line(self, line: str) -> tuple[float, str]:
        """Log-odds of body against furniture by a stripped line's own words and look, and its look."""
        if (known := self.met.get(line)) is None:
            seen = look(line)
            ts = grams(line, seen)
            known = sum(map(self.__getitem__, ts)) / len(ts) ** 0.5 + self.bias, seen
            if len(line) <= 80:
                if len(self.met) >= self.cached // 4:
                    self.met.clear()
                self.met[line] = known
        return known


class Around(dict):
    """Hashed weights by feature of a line's surroundings, which are few."""

    def __init__(self, weights: np.ndarray, cached: int) -> None:
        super().__init__()
        self.weights, self.bias, self.cached = weights, float(weights[-1]), cached

    def __missing__(self, feature: tuple) -> float:
        if len(self) >= self.cached:
            self.clear()
        w = self[feature] = float(self.weights[spot(feature)])
        return w


@lru_cache(maxsize=1 << 18)
def spot(feature: tuple) -> int:
    return crc32(repr(feature).encode("utf-8", "surrogatepass")) % AROUND


def surroundings(scores: list[float], looks: list[str], gaps: list[bool]) -> list[list[tuple]]:
    """Features of each non-blank line by the scores and looks of itself and its neighbours.

    ``gaps`` tells whether a blank line stands before a line. Scores count in steps.
    """
    n = len(scores)
    step = [max(-4, min(4, int(s / 1.5 + (0.5 if s >= 0 else -0.5)))) for s in scores]
    coarse = [x[:1] if x[:1] in "*-•»›>1" else x[0] for x in looks]
    above, low = [], 9
    for s in step:  # the least step above each line
        above.append(low)
        low = min(low, s)
    below, low = [9] * n, 9
    for i in range(n - 1, -1, -1):
        below[i] = low
        low = min(low, step[i])
    text = [i for i, s in enumerate(step) if s >= 3]
    first, last = (text[0], text[-1]) if text else (n, -1)
    out = []
    head = 0
    for i in range(n):
        gap = gaps[i]
        if gap or i == 0:
            head = i
        before = step[i - 1] if i else 5
        after = step[i + 1] if i + 1 < n else 5
        after_gap = gaps[i + 1] if i + 1 < n else True
        where = (i > first) + 2 * (i < last)
        c, s = coarse[i], step[i]
        out.append(
            [
                ("s", s), ("l", s, looks[i]), ("p", before, gap), ("n", after, after_gap), ("pn", before, gap, after, after_gap), ("sp", s, before, gap), ("sn", s, after, after_gap), ("cp", c, before, gap, looks[i - 1][:1] if i else ""),
                ("a", min(above[i], 1), min(below[i], 1), where), ("ca", c, min(above[i], 1), min(below[i], 1), where), ("h", min(step[head:i], default=5), c), ("hp", step[head] if head < i else 5, c, before), ("e", min(i, 3), min(n - 1 - i, 3), s), ("pp", step[i - 2] if i > 1 else 5, before, gap), ("lb", looks[i - 1] if i else "", gap, after_gap, s),
            ]
        )
    return out


def lined(text: str) -> tuple[list[int], list[str], list[bool]]:
    """Numbers and stripped text of the non-blank lines, and whether a blank line stands before each."""
    at, kept, gaps, blank = [], [], [], False
    for i, x in enumerate(text.split("\n")):
        if x := x.strip():
            at.append(i)
            kept.append(x)
            gaps.append(blank)
            blank = False
        else:
            blank = True
    return at, kept, gaps


def train(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, dimensions: int, ridge: float = 1e-6, rounds: int = 50, rate: float = 0.3) -> np.ndarray:
    """Weights and bias (last) of a logistic regression with an L2 penalty by Adagrad; features weigh 1 / sqrt of their number."""
    w = np.zeros(dimensions + 1)
    if not len(sizes) or labels.min() == labels.max():
        return w
    row, scale, starts = np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(sizes), np.cumsum(sizes) - sizes
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    past = np.full(dimensions + 1, 1e-12)
    for _ in range(rounds):
        z = np.add.reduceat(w[flat], starts) * scale + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.append(np.bincount(flat, weights=(g * scale)[row], minlength=dimensions), g.sum()) + ridge * np.append(w[:-1], 0)
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
    return w


def example(text: str) -> tuple[list, list, list, list]:
    """Labels, hashed features, looks and gaps of a page's lines, of at most FIT_LINES lines spread over the page."""
    at, kept, gaps = lined(text)
    weak = weak_labels(text.split("\n"))
    if len(at) > FIT_LINES:
        a = crc32(text.encode("utf-8", "surrogatepass")) % (len(at) - FIT_LINES)
        at, kept, gaps = at[a : a + FIT_LINES], kept[a : a + FIT_LINES], gaps[a : a + FIT_LINES]
    looks = [look(x) for x in kept]
    idx = [[crc32(g.encode("utf-8", "surrogatepass")) % DIMENSIONS for g in grams(x, s)[-FIT_FEATURES:]] for x, s in zip(kept, looks)]
    return [weak[i] for i in at], idx, looks, gaps


def fitted(rows: list[tuple[list, list, list, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Both models out of labelled pages: the first from every other page, the second, over its scores, from the rest.

    Fewer than 100 pages train both.
    """
    first, second = (rows[::2], rows[1::2]) if len(rows) >= 100 else (rows, rows)

    def flat(lists: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        lists = list(lists)
        return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def signs(labelled: Iterable[int]) -> np.ndarray:
        return np.fromiter((y > 0 for y in labelled), float)

    own = train(*flat(f for ys, fs, _, _ in first for y, f in zip(ys, fs) if y), signs(y for ys, *_ in first for y in ys if y), DIMENSIONS)
    idx, sizes = flat(f for _, fs, _, _ in second for f in fs)
    scores = (np.add.reduceat(own[idx], np.cumsum(sizes) - sizes) / np.sqrt(sizes) + own[-1]).tolist() if len(sizes) else []
    near, at = [], 0
    for ys, fs, looks, gaps in second:
        near += [list(map(spot, f)) for y, f in zip(ys, surroundings(scores[at : at + len(fs)], looks, gaps)) if y]
        at += len(fs)
    around = train(*flat(near), signs(y for ys, *_ in second for y in ys if y), AROUND)
    return own.astype(np.float32), around.astype(np.float32)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both models, from a hash sample of about ``fit_pages`` pages; without furniture all are 0."""
    slim = pages.select("id", "text").where("id is not null and text is not null")
    total = slim.count()
    sample = slim if total <= fit_pages else slim.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(fit_pages / total * (1 << 30)))

    def scan(ids: list, texts: list) -> list[tuple]:
        return [(i, *example(t)) for i, t in sorted(set(zip(ids, texts)))]

    rows = map_columns(spread(sample), scan, "id string, y array<int>, idx array<array<int>>, looks array<string>, gaps array<boolean>").toArrow().to_pylist()
    return fitted([(r["y"], r["idx"], r["looks"], r["gaps"]) for r in sorted(rows, key=lambda r: (crc32(r["id"].encode()), r["id"]))])


def runs(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (from, to, sum) of a sequence, disjoint, by one linear scan with a stack."""
    held: list[tuple[int, int, float, float]] = []  # from, to, sum before the run, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, left, right = i, before, total
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                break
            a, left = held[j][0], held[j][2]
            del held[j:]
        held.append((a, i, left, right))
    return [(a, b, right - left) for a, b, left, right in held]


def furniture(text: str, weights: Weights, least: float = LEAST) -> list[int]:
    """Numbers of the non-empty lines outside title and body.

    The run of lines with the largest sum is the body; other maximal runs of at least ``least`` are body too,
    as titles and paragraphs may be cut off by furniture. Within a run, lines of negative score are furniture.
    Weights that were never trained, for want of labelled furniture, find none.
    """
    at, kept, gaps = lined(text)
    if not at or not weights.trained:
        return []
    own = [weights.line(x) for x in kept]
    near = surroundings([s for s, _ in own], [x for _, x in own], gaps)
    get, bias = weights.near.__getitem__, weights.near.bias
    scores = [max(-BOUND, min(BOUND, sum(map(get, f)) / len(f) ** 0.5 + bias)) for f in near]
    found = runs(scores)
    best = max(found, key=lambda r: r[2], default=None)
    body: set[int] = set()
    for r in found:
        if r is best or r[2] >= least:
            body.update(i for i in range(r[0], r[1] + 1) if scores[i] > 0)
    return [i for k, i in enumerate(at) if k not in body]


def bodies(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id, body, furniture) for pages (id, text): the text without furniture, and its line numbers.

    Null ids and null texts give no row; a blank text has no furniture. Repeated pages give repeated rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, fit_pages))

    def scan(batches: Iterator[list[list]]) -> Iterator[list]:
        weights = Weights(*shared.value)
        for ids, texts in batches:
            out = []
            for i, t in zip(ids, texts):
                off = furniture(t, weights)
                gone = set(off)
                out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone).strip("\n") if off else t, off))
            yield out

    whole = spread(pages.select("id", "text").where("id is not null and text is not null"))
    return map_stream(whole, scan, "id string, body string, furniture array<int>")


def furniture_lines(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id, line_no) of furniture lines, each once."""
    return bodies(pages, fit_pages).select("id", F.explode("furniture").alias("line_no")).distinct()
