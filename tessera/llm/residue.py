"""Template residue, filler, error pages and scripts-required notices.

A regularized linear classifier on hashed n-grams, length and title features scores the passages of every
document. It is trained here on a bounded sample with weak labels (response statuses, known phrases, marks of
template languages) and validated on hosts it has not seen. A document is excluded if a suspect passage holds
an unfilled placeholder by the exact grammar, or if suspect passages make up most of its content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns, map_stream
from tessera.functions.words import visible
from tessera.sources.tables import spread

#: Dimensions of the hashed features; documents of the training sample, and about as many passages of one at most; share of negatives kept.
DIMENSIONS, FIT_DOCS, FIT_PASSAGES, NEGATIVES = 1 << 17, 8_000, 300, 0.3
#: Probability from which a passage is suspect: for the placeholder grammar, and as content.
LOOSE, SUSPECT, MAIN = 0.005, 0.6, 0.5

FORMULA = re.compile(r"\$\$[^$]+\$\$|\$(?![{A-Z])[^$\n{]*(?:\{[^$\n]*)?\$")
NAME = r"[A-Za-z][\w.]{2,}"
#: General names of fields that stand in single brackets (fixed values).
FIELDS = "author|title|name|teacher|student|date|email|address|company|city|phone|subject|content|answer|question|problem|solution|example|image|link|text|description|summary|username|signature|location|price|product|country|number"
#: Unfilled placeholders of template languages and forms.
PLACEHOLDER = re.compile(
    rf"\{{\{{[{{#/^&~-]?\s*{NAME}(?:\s*\|[^{{}}\n]*)?\s*\}}\}}|\$\{{\s*{NAME}\s*\}}|\{{%-?\s*{NAME}[^%\n]*%\}}|<%[-=]?\s*{NAME}[^%\n]*%>|\[\[\s*{NAME}\s*\]\]|<<\s*{NAME}\s*>>|@@{NAME}@@|@\{{{NAME}\}}|#\{{{NAME}\}}"
    rf"|(?<![\w%])%{NAME}%(?![\w%])|%\({NAME}\)[sd]|(?<![\w#])#{NAME}#(?![\w#])|(?<![\w.])__[A-Za-z][A-Za-z_]*[A-Za-z]__(?![\w(])|\[[a-z]+(?:[_.][a-z]+)+\]|\[[A-Z]+(?:_[A-Z]+)+\]|\[(?:{FIELDS})\]|\{{[a-z]+(?:_[a-z]+)+\}}"
    r"|\[(?:INSERT|ADD|ENTER|PLACE|FILL IN|TODO|TBD|TK|YOUR|Insert|Add|Enter|Place|Your)\b[^\]\n]{1,60}\]|<[^<>\n]{2,40} to be (?:added|filled in|inserted|completed|announced)>|\((?:[^()\n]{2,40}) pending\b[^()\n]*\)|[【\[（(](?:此处|在此|请在此)?(?:填写|插入|输入)[^】\]）)\n]{0,40}[】\]）)]"
    r"|\bXXX+ [^\n]{1,40}? XXX+\b|\b(?:TODO|FIXME|TBD): *\w[^\n]{0,60}"
)
#: Names that a language reserves between double underscores (fixed values).
RESERVED = re.compile(r"__(?:name|main|init|file|doc|all|dict|class|str|repr|len|call|getitem|setitem|iter|next|enter|exit|new|del|slots|version|import|future)__")
#: The same marks where a text speaks about them.
BEFORE = re.compile(r"(?i)(?:\bthe (?:text|string|mark|token|expression|syntax|notation|variable)|\busers (?:write|type)|\bsuch as|\bcalled|占位符|语法|写作)\s*[\"'`“]?$")
AFTER = re.compile(r"(?i)^[\"'`”]?\s*(?:stands? for|means\b|denotes\b|refers to|is (?:replaced|the syntax|written|a placeholder)|marks\b|表示|代表)")

#: Phrases of statuses, failures, script notices and filler, the weak labels (fixed values).
PHRASES = re.compile(
    r"(?i)^\W*(?:[45]\d\d|(?:error|http|status)\W*[45]\d\d\b.*|[45]\d\d\W+(?:bad|unauthorized|forbidden|not found|internal|bad gateway|service|gateway|error|page)\b.*|(?:page |file )?not found|access denied|forbidden|page (?:not found|cannot be found|does not exist)|internal server error|service (?:temporarily )?unavailable|(?:bad gateway|gateway time-?out)\b.*"
    r"|(?:fatal error|parse error|warning|notice|uncaught \w+)\s*:.*(?:\.php|on line \d|undefined|exception).*|traceback \(most recent call last\).*|(?:key|type|value|attribute|index|name|runtime)error: .*|file \"[^\"]+\", line \d+.*|(?:database|upstream|server) (?:connect(?:ion)?) (?:failed|error).*|something went wrong.*|an (?:unexpected )?error (?:has )?occurred.*"
    r"|(?:your )?session has expired|this account (?:is|has been) suspended|you do not have (?:permission|access)\b.*|please try again (?:later|in \d+).*|reference id \S+|contact the administrator\b.*|report this to the webmaster|our team has been (?:told|notified)|if you typed the address.*|go back to the (?:start|home) ?page|too many requests\b.*|gateway time-?out\b.*|the page you (?:were|are) looking for\b.*"
    r"|.*\b(?:enable|turn on|switch on|activate|allow|requires?|needs?|blocked|disabled|without)\b.{0,30}\b(?:javascript|js|scripts?|scripting|cookies)\b.*|.*\b(?:does not (?:run|support) (?:(?:java)?script\w*|js)|checking your browser|just a moment|missing feature: script\w*)\b.*|noscript\b.*|app shell\b.*|loading\W*"
    r"|.*\b(?:aktivieren sie|braucht|benötigt)\b.{0,40}(?:skripte|javascript|js)\b.*|.*\b(?:necesita|active|habilite)\b.{0,30}(?:scripts|javascript|js)\b.*|.*\b(?:activez|nécessite|activer)\b.{0,30}(?:scripts|javascript|js)\b.*|.*(?:включите|требуется)\s.{0,20}(?:javascript|скрипты|js).*|.*(?:启用|开启|打开|需要).{0,10}(?:javascript|js|脚本).*"
    r"|página no encontrada|seite nicht gefunden|page (?:introuvable|non trouvée)|страница не найдена|页面不存在|页面未找到|访问被拒绝|服务器(?:内部)?错误.*|找不到.*页面"
    r"|(?:dummy|sample|placeholder|example) (?:paragraph|text|content)(?: \d+)?|(?:heading|subtitle|paragraph|item|title|section|caption) (?:text|here|one|two|placeholder)|(?:test\W+){2,}\d*|(?:blah\W*){2,}\d*|(?:asdf|qwer|asdfgh|qwerty)(?:\W+(?:asdf|qwer|\w{1,4}))*|(?:your )?(?:text|content|title|name) (?:goes )?here(?: \d+)?|(?:insert|enter|click to (?:add|edit)) (?:your )?(?:text|title|content)(?: here)?|这里是占位文字\W*\d*|.*\b(?:lorem|ipsum)\b.*\b(?:lorem|ipsum|dolor|amet)\b.*)\W*\d*\W*$"
)
#: Passages longer than this are no phrase.
PHRASE_CHARS = 300
#: Words of the best-known filler text; a text where they keep coming is filler throughout.
LOREM = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing)\b")
DIGITS = re.compile(r"\d+")
TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")
HAN_RUN = re.compile("[一-鿿]{3,}")


def placeholders(passage: str) -> list[str]:
    """Placeholders of a passage that are left unfilled, not spoken about; formulas hold none."""
    bare = FORMULA.sub(" ", passage) if "$" in passage else passage
    return [m[0] for m in PLACEHOLDER.finditer(bare) if not (RESERVED.fullmatch(m[0]) or BEFORE.search(bare[: m.start()]) or AFTER.match(bare[m.end() :]))]


def passages(text: str) -> list[str]:
    """Lines, cut after each sentence."""
    for end in (". ", "! ", "? "):
        text = text.replace(end, end[0] + "\n")
    if not text.isascii():
        for end in "。！？":
            text = text.replace(end, end + "\n")
    return [p for p in text.split("\n") if p and not p.isspace()]


def letters(passage: str) -> int:
    return sum(map(str.isalnum, passage))


def grams(passage: str) -> list[str]:
    """Words and marks of a lowered passage; Han runs give pairs of characters."""
    ts = TOKEN.findall(passage)
    if not passage.isascii():
        ts = [x for t in ts for x in ((t[i : i + 2] for i in range(len(t) - 1)) if HAN_RUN.match(t) else (t,))]
    return ts


def lowered(text: str) -> str:
    """In lower case, with each run of digits as one 0."""
    return DIGITS.sub("0", text.lower())


def index(gram: str | tuple[str, str]) -> int:
    return crc32((gram if isinstance(gram, str) else " ".join(gram)).encode("utf-8", "surrogatepass")) % DIMENSIONS


class Scorer(dict):
    """Weights of hashed n-grams, with a bounded cache of the n-grams met."""

    def __init__(self, weights: np.ndarray, cached: int = 1 << 20) -> None:
        super().__init__()
        self.weights, self.bias, self.cached = weights, float(weights[DIMENSIONS]), cached
        self.passages: dict[str, float] = {}

    def __missing__(self, gram: str | tuple[str, str]) -> float:
        if len(self) >= self.cached:
            self.clear()
        w = self[gram] = float(self.weights[index(gram)])
        return w

    def logit(self, passage: str, title: bool) -> float:
        """The log-odds that a lowered passage is residue; passages that keep coming are remembered."""
        if not title and (known := self.passages.get(passage)) is not None:
            return known
        fs = features(passage, title)
        z = sum(map(self.__getitem__, fs)) / len(fs) ** 0.5 + self.bias
        if not title:
            if len(self.passages) >= self.cached // 8:
                self.passages.clear()
            self.passages[passage] = z
        return z


def features(passage: str, title: bool) -> list:
    """n-grams of a lowered passage, its length class and, for a first line, the same words as title features."""
    ts = grams(passage)
    out = [*ts, *zip(ts, ts[1:])]
    out.append(f"<length {min(len(ts).bit_length(), 7)}>")
    if title:
        out += ["<title> " + t for t in ts[:12]]
    return out


def weak_labels(text: str) -> list[tuple[str, bool, int]]:
    """(passage, is title, label): 1 residue, 0 content, -1 unknown.

    A passage with an unfilled placeholder is residue; in a text that is phrases of notices or filler in the
    main, all passages are. Passages of texts without any such phrase are content, and so are phrases that
    stand alone in a long text.
    """
    ps = passages(text)
    held = [bool(placeholders(p)) for p in ps]
    said = [len(p) <= PHRASE_CHARS and bool(PHRASES.match(p.strip())) for p in ps]
    total = sum(map(letters, ps)) or 1
    share = sum(letters(p) for p, s in zip(ps, said) if s) / total
    lorem = len(LOREM.findall(text))
    if lorem >= 2 and lorem * 40 >= text.count(" "):
        share = 1.0
    out = []
    for i, p in enumerate(ps):
        if held[i] or share >= 0.4:
            y = 1
        elif share < 0.1 and lorem < 2:
            y = 0
        else:
            y = -1
        out.append((p, i == 0 and "\n" in text, y))
    return out


def examples(docs: DataFrame, fit_docs: int = FIT_DOCS, negatives: float = NEGATIVES) -> DataFrame:
    """(host, label, idx): labelled passages of a hash sample of ``fit_docs`` documents (doc_id, source, text).

    A document gives about FIT_PASSAGES passages at most, so that what the driver gets is bounded.
    """
    total = docs.count()
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("text is not null and doc_id is not null")
    if total > fit_docs:
        slim = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(fit_docs / total * (1 << 30)))
    keep = int(negatives * 2**32)

    def scan(_: list, hosts: list, texts: list) -> list[tuple]:
        out = []
        for h, x in zip(hosts, texts):
            told = weak_labels(visible(x))
            few = int(2**32 * min(1.0, FIT_PASSAGES / (len(told) or 1)))  # of a long text a share of its passages
            for p, t, y in told:
                draw = crc32(p.encode("utf-8", "surrogatepass"))
                if (y > 0 and draw < few) or (y == 0 and draw < min(keep, few)) or (y == 0 and t):
                    out.append((h, y, [index(f) for f in features(lowered(p), t)]))
        return out

    return map_columns(spread(slim), scan, "host string, label int, idx array<int>")


def train(idx: list[np.ndarray], labels: np.ndarray, ridge: float = 1e-6, rounds: int = 120, rate: float = 0.3) -> np.ndarray:
    """Weights and bias (last) of a logistic regression by Adagrad: mean loss with balanced classes, and an L2 penalty of ``ridge``."""
    w = np.zeros(DIMENSIONS + 1)
    if not len(idx) or labels.min() == labels.max():
        return w
    sizes = np.array([len(i) for i in idx])
    flat, row = np.concatenate(idx), np.repeat(np.arange(len(idx)), sizes)
    scale = 1 / np.sqrt(sizes)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    past = np.full(DIMENSIONS + 1, 1e-10)
    for _ in range(rounds):
        z = np.bincount(row, weights=w[flat], minlength=len(idx)) * scale + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.append(np.bincount(flat, weights=(g * scale)[row], minlength=DIMENSIONS), g.sum()) + ridge * np.append(w[:-1], 0)
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
    return w


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, validate: bool = True) -> tuple[np.ndarray, dict[str, float]]:
    """The weights, and precision and recall on passages of hosts left out of the training (a fifth by hash).

    The final weights are trained on all hosts; ``validate`` trains once more without the hosts left out.
    """
    rows = examples(docs, fit_docs).toArrow()
    idx = [np.asarray(x, np.int64) for x in rows.column("idx").to_pylist()]
    y = rows.column("label").to_numpy().astype(float) if len(rows) else np.zeros(0)
    unseen = np.array([crc32(h.encode()) % 5 == 0 for h in rows.column("host").to_pylist()], bool)
    told = {"passages": float(len(y)), "unseen": float(unseen.sum()), "precision": 0.0, "recall": 0.0}
    if validate and unseen.any() and not unseen.all():
        w = train([i for i, u in zip(idx, unseen) if not u], y[~unseen])
        z = np.array([w[i].sum() / np.sqrt(len(i)) + w[-1] for i, u in zip(idx, unseen) if u])
        hit, true = z > 0, y[unseen] > 0
        told["precision"], told["recall"] = float((hit & true).sum() / max(1, hit.sum())), float((hit & true).sum() / max(1, true.sum()))
    return train(idx, y), told


def judged(text: str, scorer: Scorer) -> str | None:
    """Why a text is excluded: placeholder, or content (filler, error page or notice in its place); None if it stays."""
    text = visible(text)
    low = passages(lowered(text))
    loose, suspect = float(np.log(LOOSE / (1 - LOOSE))), float(np.log(SUSPECT / (1 - SUSPECT)))
    z = [scorer.logit(p, i == 0 and len(low) > 1) for i, p in enumerate(low)]
    if not z or max(z) <= loose:
        return None
    ps = passages(text)
    if any(s > loose and placeholders(p) for p, s in zip(ps, z)):
        return "placeholder"
    if max(z) <= suspect:
        return None
    size = [letters(p) for p in ps]
    body = sum(size[1:]) if len(ps) > 2 and z[0] <= suspect and size[0] < 80 else sum(size)
    bad = sum(n for n, s in zip(size, z) if s > suspect)
    lean = sum(n * s for n, s in zip(size, z))  # the log-odds of the whole, passages weighed by their letters
    return "content" if body and bad > MAIN * body and lean > 0 else None


def excluded(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, reason) of the documents (doc_id, source, text) to exclude, each once.

    Null ids, null and blank texts give no row; a null source is a host of its own.
    """
    weights, _ = fit(docs, fit_docs, validate=False)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[list[list]]) -> Iterator[list]:
        scorer = Scorer(shared.value)
        for ids, texts in batches:
            yield [(i, r) for i, t in zip(ids, texts) if (r := judged(t, scorer))]

    whole = spread(docs.select("doc_id", "text").where(r"doc_id is not null and text rlike '\\S'"))
    return map_stream(whole, scan, f"doc_id {kind}, reason string").groupBy("doc_id").agg(F.min("reason").alias("reason"))
