"""Markup residue in text: which notations are left, and the clean text.

Formulas are masked first, so that nothing inside them is read as markup. Each notation has its own marks;
stripping keeps headings, list items, code and formulas. The text lengths of the stripped lines are summed over
sliding windows of lines: from the first surge of these sums to the last dive everything stays. Before and after
only structure, sentences, results and a single line (a title, a closing word) stay, so that menus and footers go.
Where nothing surges there is no text, as in random symbols, and its marks are no residue.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.words import HAN
from tessera.sources.tables import spread

FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
#: Element names of HTML (fixed values).
TAGS = (
    "a abbr address area article aside audio b big blockquote body br button canvas caption center cite code col dd del details dfn div dl dt em fieldset figcaption figure font footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option p param picture pre q s samp script "
    "section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
)
_NAME = "(?:" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + ")"
TAG = re.compile(rf"</{_NAME}\s*>|<{_NAME}(?:\s+[a-zA-Z_:][-\w:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*\s*/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")

MD_HEADING = re.compile(r"^ {0,3}(#{1,6}) +(\S.*?)(?: +#+)? *$", re.M)
MD_UNDERLINED = re.compile(r"(?:^|\n\n)(?=.*\w)([^\n|]{1,80}[^\n|.!?:;,])\n(={3,}|-{3,}) *$", re.M)
MD_BOLD = re.compile(r"\*\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*|(?<![\w_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])")
MD_ITALIC = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
MD_STRIKE = re.compile(r"~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(\s*<?[^()\s]+>?(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)|!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
MD_REF = re.compile(r"^ {0,3}\[[^\]\n]+\]: +\S+.*$", re.M)
MD_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
MD_QUOTE = re.compile(r"^ {0,3}(?:> ?)+(?=\S)", re.M)
MD_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*$", re.M)
MD_CODE = re.compile(r"(?<![`\\])(`{1,2})(?=[^`\n])([^`\n]*[^`\n])\1(?!`)")

WIKI_HEADING = re.compile(r"^(={2,6}) *([^=\n](?:[^\n]*?[^=\n])?) *\1 *$", re.M)
WIKI_EMPHASIS = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])([^'\n](?:[^\n]*?[^'\s])?)\1(?!')")
WIKI_LINK = re.compile(r"\[\[(?=[^\[\]\n]*[^\W\d_]{2})(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]")
WIKI_FILE = re.compile(r"\[\[:?(?:File|Image|Media|Category|Datei|Bild|Fichier|Archivo|Imagen|Kategorie)\s*:(?:[^\[\]\n]|\[\[[^\[\]\n]*\]\])*\]\]", re.I)
WIKI_OUTER = re.compile(r"\[(?:https?|ftp):\S+ +([^\]\n]+)\]")
WIKI_TEMPLATE = re.compile(r"\{\{(?=[^{}]*[^\W\d_]{2})[^{}]*\}\}")
WIKI_TAG = re.compile(r"</?(?:ref|math|syntaxhighlight|source|nowiki|gallery|references)(?:\s[^<>]*)?/?>", re.I)
WIKI_NOTE = re.compile(r"<ref(?:\s[^<>]*)?(?:/>|>.*?</ref>)", re.I | re.S)

_ARG = r"(?:\[[^\]\n]*\])*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
TEX_SECTION = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title|caption)\*?" + _ARG)
TEX_FONT = re.compile(r"\\(?:textbf|textit|textsl|texttt|textsc|textsf|textrm|textmd|textup|textnormal|emph|underline|uline|mbox)" + _ARG)
TEX_OLD_FONT = re.compile(r"\{\\(?:bf|it|tt|sc|sl|sf|rm|em|bfseries|itshape|ttfamily|scshape|small|footnotesize|tiny|large|Large|LARGE|huge|Huge|normalsize|centering)\b\s*([^{}]*)\}")
TEX_DROP = re.compile(r"~?\\(?:label|cite[a-z]*|ref|eqref|pageref|autoref|footnote|footnotetext|footnotemark|thanks|marginpar|vspace|hspace|index|bibliography|bibliographystyle|usepackage|documentclass|input|include|includegraphics|author|date|pagestyle|addcontentsline)\*?(?:\[[^\]\n]*\])*\{(?:[^{}]|\{[^{}]*\})*\}")
TEX_BARE = re.compile(r"\\(?:noindent|indent|smallskip|medskip|bigskip|newpage|clearpage|pagebreak|linebreak|newline|hfill|vfill|maketitle|tableofcontents|centering|raggedright|appendix|footnotemark|par)(?![a-zA-Z])")
TEX_ENV = re.compile(r"\\(?:begin|end)\{(?!(?:[bBpvV]?matrix|smallmatrix|cases|array)\*?\})([a-zA-Z]+)\*?\}(?:\[[^\]\n]*\])?")
TEX_ITEM = re.compile(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", re.M)

NOTATIONS = {
    "html": (TAG, COMMENT, ENTITY),
    "markdown": (MD_HEADING, MD_BOLD, MD_ITALIC, MD_STRIKE, MD_LINK, MD_REF, MD_AUTO, MD_QUOTE, MD_FENCE, MD_CODE, MD_UNDERLINED),
    "wiki": (WIKI_HEADING, WIKI_EMPHASIS, WIKI_LINK, WIKI_FILE, WIKI_OUTER, WIKI_TEMPLATE, WIKI_TAG),
    "latex": (TEX_SECTION, TEX_FONT, TEX_OLD_FONT, TEX_DROP, TEX_BARE, TEX_ENV, TEX_ITEM),
}
#: Characters without which none of a notation's marks can occur.
SIGNS = {"html": "<&", "markdown": "#*_~[<>`=-", "wiki": "='[{<", "latex": "\\"}
#: Lines of a window; a surge is a sum above this many letters, or this part of the largest sum if that is less.
WINDOW, SURGE, PART = 3, 100, 0.35
#: A line of which less than this part is letters holds no text; a formula counts as so many letters.
LETTERS, FORMULA_LETTERS = 0.35, 8
#: Lines that stay outside the text: headings, items, code marks, formulas, rows of numbers, ends of sentences and results.
STRUCTURE = re.compile(r"\s*(?:#{1,6} |[#*]+ ?\w|[-+•] |\(?(?:\d{1,3}|[a-z])[.)] |```|\|)|.*(?:\$|\\[a-zA-Z(\[]|=|\t|\d\s*(?:[|;,]|\s\s)\s*-?\d|[.!?。！？:：;；∎■□][\"'”’)\]]*\s*$|[:：]\s*\S{0,3}\d)")


def masked(text: str) -> tuple[str, list[str]]:
    """The text with each formula replaced by a placeholder of one private character, and the formulas."""
    kept: list[str] = []
    if "$" not in text and "\\" not in text:
        return text, kept

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return "\ue000"

    return FORMULA.sub(hide, text), kept


def markups(text: str) -> list[str]:
    """The notations whose marks stand in ``text``, in the order of NOTATIONS."""
    bare, _ = masked(text)
    return [n for n, marks in NOTATIONS.items() if any(c in bare for c in SIGNS[n]) and any(m.search(bare) for m in marks)]


def inner(m: re.Match) -> str:
    return next((g for g in m.groups() if g is not None), "")


def stripped(text: str, found: list[str]) -> str:
    """The text without the marks of ``found``."""
    t, formulas = masked(text)
    if "wiki" in found:
        t = re.sub(r"<syntaxhighlight[^>]*>|</syntaxhighlight>|<source[^>]*>|</source>", "```", t, flags=re.I)
        t = re.sub(r"<math[^>]*>(.*?)</math>", r"$\1$", t, flags=re.S | re.I)
        t = WIKI_TAG.sub("", WIKI_TEMPLATE.sub("", WIKI_FILE.sub("", WIKI_NOTE.sub("", t))))
        t = WIKI_HEADING.sub(lambda m: "#" * len(m[1]) + " " + m[2], t)
        t = WIKI_EMPHASIS.sub(lambda m: m[2], WIKI_OUTER.sub(inner, WIKI_LINK.sub(inner, t)))
    if "html" in found:
        t = COMMENT.sub("", t)
        t = re.sub(r"<h([1-6])[^>]*>\s*(.*?)\s*</h[1-6]>", lambda m: "#" * int(m[1]) + " " + m[2], t, flags=re.S | re.I)
        t = re.sub(r"<pre[^>]*>\s*(?:<code[^>]*>)?|(?:</code>)?\s*</pre>", "\n```\n", t, flags=re.I)
        t = re.sub(r"<li[^>]*>\s*", "- ", t, flags=re.I)
        t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
        t = html.unescape(TAG.sub("", t))
    if "latex" in found:
        t = re.sub(r"\\(section|subsection|subsubsection|chapter|part|title|paragraph)\*?" + _ARG, lambda m: "#" * {"section": 2, "subsection": 3, "subsubsection": 4}.get(m[1], 1) + " " + m[2], t)
        t = re.sub(r"\\(?:begin|end)\{(?:verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?", "```", t)
        t = re.sub(r"\\(?:begin|end)\{(?:equation|align|gather|displaymath|eqnarray|multline)\*?\}", "$$", t)
        t = TEX_ITEM.sub(lambda m: "- " + (m[1] + " " if m[1] else ""), t)
        t = TEX_BARE.sub("", TEX_DROP.sub("", TEX_ENV.sub("", t)))
        for _ in range(3):
            t = TEX_OLD_FONT.sub(r"\1", TEX_FONT.sub(r"\1", TEX_SECTION.sub(r"\1", t)))
    if "markdown" in found:
        t = MD_UNDERLINED.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t)
        t = MD_REF.sub("", MD_AUTO.sub(r"\1", MD_LINK.sub(inner, t)))
        t = MD_STRIKE.sub(inner, MD_ITALIC.sub(inner, MD_BOLD.sub(inner, MD_QUOTE.sub("", t))))
        t = MD_CODE.sub(r"\2", t)
    parts = iter(formulas)
    return re.sub("\ue000", lambda m: next(parts), t) if t.count("\ue000") == len(formulas) else t


def text_length(line: str) -> int:
    """Letters of a line, a Han letter as two, and of its formulas; 0 where letters are too few for text."""
    formulas, bare = 0, line
    if "$" in line or "\\" in line:
        bare, formulas = FORMULA.subn(" ", line)
        if formulas and sum(map(str.isalnum, line)) < LETTERS * (len(line) - line.count(" ")):
            return 0
    letters = sum(map(str.isalpha, bare))
    if letters < LETTERS * (len(bare) - sum(map(bare.count, " \t\u3000\u00a0"))):
        letters = 0
    elif not bare.isascii():
        letters += len(HAN.findall(bare))
    return letters + FORMULA_LETTERS * formulas


def line_blocks(sizes: list[int], window: int = WINDOW, surge: int = SURGE, part: float = PART) -> list[tuple[int, int]]:
    """Blocks (from, to) of lines between a surge and a dive of the line-block distribution.

    ``sizes`` are the lines' text lengths, their sums run over ``window`` lines. A surge is where the sums rise
    above ``surge`` (or ``part`` of the largest), a dive where they fall to it again. As a window sees the lines
    below it, a block opens at its first line that is itself a third of that.
    """
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    bound = min(surge, part * max(sums, default=0))
    out, at = [], None
    for i, s in enumerate([*sums, 0]):
        if s > bound and at is None:
            at = i
        elif s <= bound and at is not None:
            first = next((k for k in range(at, i) if sizes[k] * window > bound), at)
            out.append((first, i))
            at = None
    return out


def clean(text: str) -> tuple[str, list[str]]:
    """Clean text and the notations found. Text without residue comes back as it is, as does one without text."""
    found = markups(text)
    if not found:
        return text, found
    lines = [x.rstrip() for x in stripped(text, found).split("\n")]
    if all(map(str.strip, text.split("\n"))):  # blank lines are only what is left of marks
        lines = list(filter(None, lines))
    blocks = line_blocks(list(map(text_length, lines)))
    if not blocks:
        return text, []
    first, last = blocks[0][0], blocks[-1][1]
    loose, code = [], False
    for i, x in enumerate(lines):
        mark = x.lstrip().startswith("```")
        if x and not (first <= i < last or code or mark or STRUCTURE.match(x)):
            loose.append(i)
        code ^= mark
    above, below = [i for i in loose if i < first], [i for i in loose if i >= last]
    title = first - 1  # the one line above the text, with or without a blank line between
    while title > 0 and not lines[title]:
        title -= 1
    gone = set(above if len(above) > 1 else ()) | set(below if len(below) > 1 else ())
    if title == 0 or (title > 0 and not lines[title - 1]):
        gone.discard(title)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for i, x in enumerate(lines) if i not in gone)).strip("\n"), found


def cleaned(records: DataFrame) -> DataFrame:
    """(rec_table, rec_key, clean_text, notations) for records (rec_table, rec_key, text).

    Null keys, null and blank texts give no row. A repeated record gives one row for each different text.
    """

    def scan(tables: list, keys: list, texts: list) -> list[tuple]:
        return [(r, k, *clean(t)) for r, k, t in zip(tables, keys, texts)]

    whole = spread(records.select("rec_table", "rec_key", "text").where(r"rec_key is not null and text rlike '\\S'"))
    return map_columns(whole, scan, "rec_table string, rec_key string, clean_text string, notations array<string>")


def residue(records: DataFrame) -> DataFrame:
    """(rec_table, rec_key, markup): the notations of which each record holds residue, without repetition."""
    return cleaned(records).select("rec_table", "rec_key", F.explode("notations").alias("markup")).distinct()
