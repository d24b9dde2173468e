"""Low-risk cleaning of web text, step by step as column expressions.

The order of the steps is part of the result: entities, tags, forum marks, control characters, tails, noise
lines, links, repeated lines, white space, page remains.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import scalar
from tessera.functions.pytext import any_of, col, let, lines, strip

# Patterns of the noise that is removed.
ENTITY = r"(?i)&(?:nbsp|lt|gt|amp|quot|apos|mdash|ndash|hellip|#\d{1,5}|#x[0-9a-fA-F]{1,4});"
TAG = r"(?i)</?(?:div|span|p|br|table|td|tr|th|ul|li|ol|h[1-6]|a|img|script|style|header|footer|nav|section|article|aside|main|form|input|button|select|textarea|iframe|embed|object|meta|link)[\s/>]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
LINK = r"(?i)https?://[^\s<>\"']+"
FORUM_LINK = r"(?is)\[url(?:=[^\]]+)?\].*?\[/url\]|\[URL(?:=\"[^\"]*\")?\].*?\[/URL\]"
FORUM_IMAGE = r"(?is)\[img\b[^\]]*\].*?\[/img\]"
FORUM_TAG = r"(?i)\[/?(?:url|img|quote|code|color|size|font|center|left|right|indent|spoiler|hide|highlight|media|video|attach)\b[^\]]*\]"
BOILERPLATE = [
    r"(?:accept|use|uses?)\s+cookies?",
    r"subscribe\s+(?:to|for|now)",
    r"sign\s*up\s+(?:for|to|now)",
    r"(?:log\s*in|sign\s*in)\s+(?:to|with|using)",
    r"(?:click\s+here|read\s+more|learn\s+more|see\s+also)\s*$",
    r"^\s*(?:menu|navigation|sidebar|footer|header|breadcrumb)\s*$",
    r"^\s*(?:previous|next)\s+(?:post|article|page)\s*$",
    r"^\s*(?:copyright|©|\(c\))\s+",
    r"^\s*all\s+rights?\s+reserved",
    r"^\s*(?:posted|published)\s+(?:on|in|by)\s+",
    r"^\s*(?:tags?|categories?|filed\s+under)\s*:\s*",
    r"^\s*\d+\s*(?:views?|likes?|shares?|retweets?)\s*$",
    r"(?:facebook|twitter|linkedin|pinterest|reddit|instagram)\s*$",
    r"^\s*(?:advertisement|sponsored|ad)\s*$",
    r"^\s*(?:get\s+(?:a\s+)?free|start\s+(?:your|a)\s+free|free\s+trial)",
    r"^\s*(?:Rate\s+this|Was\s+this\s+helpful|Helpful\s*\?)",
    r"^\s*(?:share\s+this|share\s+on|tweet|pin\s+it)\s*",
    r"^\s*(?:Disclaimer|Terms\s+of\s+(?:Service|Use)|Privacy\s+Policy)\s*$",
    r"^\s*(?:About\s+the\s+(?:Author|Creator))\s*$",
    r"^\s*Not\s+the\s+answer\s+you.re\s+looking\s+for",
    r"^\s*Browse\s+other\s+questions?\s+tagged",
    r"^\s*(?:Report\s+(?:an?\s+)?(?:error|issue|bug|problem))\s*$",
]
NOISE = [
    r"^\s*(?:https?://\S+|\[url\].*?\[/url\])\s*$",
    r"^\s*\d*\s*Attachment\(s\)\s*$|^\s*(?:Save this PDF as|Size:\s*px|Start display at)",
    r"^\s*-\s*(?:-\s*)*\w.*\(https?://[^\)]+\)\s*$",
    r"^\s*[\w.-]+\.(?:org|com|net|edu|io)\s*\(https?://[^\)]+\)\s*$",
    r"^\s*All times are (?:UTC|GMT|EST|PST|CET)",
    r"^\s*(?:•\s*)?(?:Commented|Posted|Edited|Updated|Answered|Asked)?\s*(?:[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}\s+(?:at\s+)?\d{1,2}:\d{2})|^\s*\w[\w\s]{0,30}\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}",
    r"^\s*•\s*.{0,50}Commented\s+\w+\s+\d",
    r"^\s*\w[\w\s]{0,30}\s*\|\s*(?:College|High School|Middle School)?\s*(?:Teacher|Educator|Student|Professor|Tutor)",
    r"^\s*Posted on\s*$",
    r"^\s*Updated:\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$",
    r"^\s*(?:Wiki User|Answered by|Asked by)\s*$|^\s*\d+[ymdh]\s+ago\s*$",
    r"^\s*Is there an error in this (?:question|solution)\??|^\s*(?:Report Error|Flag as Inappropriate|Mark as Brainliest)\s*$",
    r"^\s*(?:APPEARS?\s+IN|SOURCE|REFERENCE)\s*$",
    r"^\s*(?:Chapter\s+\d+\s+\w+|Exercise\s+[\d.]+\s*\|\s*Q\s*\d+\s*\|\s*Page\s*\d+)\s*$",
    r"^\s*Concept:\s*\w+",
    r"(?:Chegg\s+Study|Slader|StudyBlue|Course\s+Hero)\s+(?:subscriber|free|solutions?)|download\s+our\s+(?:homework\s+)?(?:help\s+)?app|redefine\s+your\s+true\s+self|Shed\s+the\s+societal",
    r"^\s*Skip\s+(?:Nav|Navigation|to\s+(?:main\s+)?content)\s*$",
    r"^\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}(?:,?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?)?\s*$",
    r"^\s*Re:\s+",
    r"^\s*(?:Save this PDF as|Size:\s*px|Start display at\s+page)\s*:?\s*$",
    r"^\s*(?:People\s*s\s+Physics|Textbook|Source)\s+book\s+\w+\s+Ch\s+[\d-]+\s*$|^\s*\d+\s+People\s+s\s+Physics",
    r"^\s*(?:#{1,4}\s+)?(?:Privacy\s+FAQs?|Main\s+Topics|Table\s+of\s+Contents|Quick\s+Links|Site\s+Map)\s*$",
    r"^\s*(?:Originally Posted by|Quote:)\s*",
    r"^\s*•\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}",
]
TAILS = [
    r"^\s*#{0,4}\s*(?:Responses?\s+to|Leave\s+a\s+(?:Reply|Comment)|Comments?\s*(?:\(\d+\))?)\s*$",
    r"^\s*#{0,4}\s*(?:Related\s+(?:Posts?|Articles?|Entries|Problems?|Questions?|Topics?|Resources?))\s*:?\s*$",
    r"^\s*#{0,4}\s*(?:You\s+(?:might|may)\s+(?:also\s+)?(?:like|enjoy|be\s+interested))",
    r"^\s*#{0,4}\s*(?:Recommended\s+(?:for\s+you|problems?|reading))",
    r"^\s*Showing\s+results?\s+for\s*$",
    r"^\s*As a Chegg Study subscriber",
    r"^\s*Now is the time to redefine your true self",
    r"^\s*Can you find your fundamental truth",
    r"^\s*You can (?:also )?(?:download|check) our",
]
PAGE_END = r"(?iU)\n\s*(?:\d+\s+)?(?:People\s*s\s+Physics|Textbook)\s+book\s+\w+\s+Ch\s+[\d-]+\s*$"
FACE = r"(?U)\s*[:;][\-]?[)D(P/\\|]\s*$"

BOILERPLATE_LINE = "(?iuUd)" + any_of(*BOILERPLATE)
NOISE_LINE = "(?iuUd)" + any_of(*NOISE)

_decoded = scalar(lambda t: t and html.unescape(t), "string", once=True)


def unescape(c: Column) -> Column:
    """HTML entities decoded; only texts with an ampersand go to Python, others as nulls."""
    return F.coalesce(_decoded(F.when(F.contains(c, F.lit("&")), c)), c)


def cut_tails(c: Column) -> Column:
    """The text up to the first line that opens a tail; the patterns cut one after the other."""
    for p in TAILS:
        c = F.regexp_replace(c, f"(?iuUdm){p}[\\s\\S]*", "")
    return c


def drop_lines(c: Column, *patterns: str) -> Column:
    """Without the lines whose stripped form matches a pattern; blank lines become empty."""
    told = F.transform(lines(c), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))

    def bad(x: Column) -> Column:
        out = x["bare"].rlike(patterns[0])
        for p in patterns[1:]:
            out = out | x["bare"].rlike(p)
        return out

    kept = F.filter(told, lambda x: (x["bare"] == "") | ~bad(x))
    return F.array_join(F.transform(kept, lambda x: F.when(x["bare"] == "", F.lit("")).otherwise(x["line"])), "\n")


def drop_repeats(c: Column) -> Column:
    """Without lines equal to the line before them; blank lines stay."""
    told = F.transform(lines(c), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    kept = lambda ls: F.filter(ls, lambda x, i: (i == 0) | (x["bare"] == "") | (x["bare"] != F.element_at(ls, F.greatest(i, F.lit(1)))["bare"]))
    return F.array_join(F.transform(let(told, kept), lambda x: x["line"]), "\n")


def squeeze(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r" {3,}", " "), r" +\n", "\n")


def plain_marks(c: Column) -> Column:
    """Tags, forum marks and control characters removed; raised and lowered text kept in formula notation."""
    c = F.regexp_replace(F.regexp_replace(c, ENTITY, " "), TAG, "")
    c = F.regexp_replace(F.regexp_replace(c, FORUM_LINK, ""), FORUM_IMAGE, "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?id)\[sup\](.*?)\[/sup\]", r"^{$1}"), r"(?id)\[sub\](.*?)\[/sub\]", r"_{$1}")
    for mark in "biu":
        c = F.regexp_replace(c, rf"(?id)\[{mark}\](.*?)\[/{mark}\]", "$1")
    return F.regexp_replace(F.regexp_replace(c, FORUM_TAG, ""), CONTROL, "")


def drop_links(c: Column) -> Column:
    """Without links that stand free between white space, then without links that open a line."""
    return F.regexp_replace(F.regexp_replace(c, r"(?Ud)(?<=\s)https?://\S+(?=\s|$)", ""), r"(?Udm)^https?://\S+\s*", "")


def page_remains(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)^\s*\d{1,3}\s*\n", "")
    return strip(F.regexp_replace(F.regexp_replace(c, PAGE_END, ""), FACE, ""))


def clean_marked(c: Column | str) -> Column:
    """All steps but the decoding of entities, which needs Python."""
    c = cut_tails(plain_marks(col(c)))
    return page_remains(squeeze(drop_repeats(drop_links(drop_lines(c, BOILERPLATE_LINE, NOISE_LINE)))))


def with_clean_text(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the cleaned text in column ``name``. Entities are decoded in a column of their own; null stays null."""
    return df.withColumn("_decoded", unescape(F.col(text))).withColumn(name, clean_marked("_decoded")).drop("_decoded")
