"""Defects of prompt and response pairs: empty, refusal, copy, language, truncated.

A suffix automaton of the prompt measures how much of the response is copied; phrase automata find refusals;
stacks of delimiters and the last line tell a broken end; stopwords and scripts vote for the languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_columns
from tessera.functions.words import HAN, visible, words
from tessera.sources.tables import spread

#: Shares of the response's letters: copied at least, and in refusing sentences at least.
COPIED, REFUSED = 0.6, 0.5
#: New words that a copy adds at most, or their part of the prompt's words.
NEW_WORDS, NEW_SHARE = 10, 0.3
#: Words in a row that count as copied.
COPY_RUN = 3


class SuffixAutomaton:
    """All runs of units of one sequence, as a minimal automaton."""

    def __init__(self, units: list[str]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for u in units:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and u not in self.next[p]:
                self.next[p][u] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][u]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(u) == q:
                        self.next[p][u] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def covered(self, units: list[str], run: int) -> list[bool]:
        """Which units of another sequence lie in a run of at least ``run`` that this one holds."""
        out = [False] * len(units)
        state = held = 0
        for i, u in enumerate(units):
            while state and u not in self.next[state]:
                state = self.link[state]
                held = self.size[state]
            if u in self.next[state]:
                state, held = self.next[state][u], held + 1
            if held >= run:
                for j in range(i - held + 1 if not out[i - 1] else i, i + 1):
                    out[j] = True
        return out


def units(text: str) -> list[str]:
    """Words in lower case; each Han character is a word."""
    return words(HAN.sub(lambda m: f" {m[0]} ", text) if not text.isascii() else text)


#: States of the automata that a worker keeps; prompts that keep coming find theirs again.
CACHED_STATES = 200_000
_automata: dict[str, SuffixAutomaton] = {}
_states = 0


def automaton(prompt: str) -> SuffixAutomaton:
    """The automaton of a prompt, remembered while all that are have at most CACHED_STATES states."""
    global _states
    if (a := _automata.get(prompt)) is None:
        a = SuffixAutomaton(units(prompt))
        if _states + len(a.next) > CACHED_STATES:
            _automata.clear()
            _states = 0
        if len(a.next) <= CACHED_STATES:
            _automata[prompt] = a
            _states += len(a.next)
    return a


def copied(prompt: str, response: str, run: int = COPY_RUN) -> tuple[float, int]:
    """Share of the response's letters and digits in runs of words copied from the prompt, and how many words are new."""
    seq = units(response)
    if not seq:
        return 0.0, 0
    hit = automaton(prompt).covered(seq, min(run, len(seq)))
    return sum(len(u) for u, h in zip(seq, hit) if h) / sum(map(len, seq)), hit.count(False)


def copied_share(prompt: str, response: str) -> float:
    return copied(prompt, response)[0]


# Phrases of refusals (fixed values): an inability or unwillingness, then what is withheld.
NOT_EN = ["can't", "cannot", "can not", "could not", "couldn't", "am not able to", "not able to", "am unable to", "unable to", "won't", "will not", "won't be", "will not be", "must decline to", "have to decline to", "decline to", "refuse to", "not going to", "isn't possible for me to", "is not possible for me to", "not possible for me to", "not allowed to", "not permitted to", "not comfortable"]
WITHHELD_EN = ["help", "helping", "assist", "assisting", "answer", "answering", "provide", "providing", "work on", "working on", "complete", "completing", "solve", "solving", "offer", "offering", "respond", "responding", "fulfill", "fulfil", "comply", "support", "do that", "do this", "do your", "handle", "process", "discuss", "give you", "give an answer", "give a solution", "continue with this", "take on", "engage"]
OUTRIGHT_EN = ["must decline", "have to decline", "i decline", "against my guidelines", "outside my guidelines", "falls outside my"]
NOT_ZH = ["无法", "不能", "没有办法", "没办法", "没法", "不会", "拒绝", "难以", "不便", "不可以", "不能够"]
WITHHELD_ZH = ["回答", "提供", "协助", "帮助", "帮", "解答", "完成", "处理", "给出", "解决", "作答", "满足", "回应"]
NOT_DE, WITHHELD_DE = ["kann ich nicht", "kann nicht", "kann leider nicht", "kann diese frage nicht", "kann dir nicht", "kann ihnen nicht"], ["helfen", "beantworten", "lösen", "antworten"]
NOT_FR, WITHHELD_FR = ["ne peux pas", "ne puis pas", "suis pas en mesure de", "suis incapable de"], ["aider", "répondre", "vous aider", "t'aider", "fournir", "résoudre"]
NOT_ES, WITHHELD_ES = ["no puedo", "no soy capaz de", "no me es posible"], ["ayudar", "ayudarte", "ayudarle", "responder", "resolver", "proporcionar"]
NOT_RU, WITHHELD_RU = ["не могу", "не в состоянии", "не смогу"], ["помочь", "ответить", "решить", "предоставить"]
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*\s*")
#: Sentences that only go along with a refusal.
COURTESY = re.compile(r"(?i)\b(sorry|apologi[sz]e|unfortunately|regrettably|thank you|thanks|please|consult|try asking|anything else|something else|another forum|let me know|guidelines|feel free)\b|抱歉|对不起|遗憾|谢谢|感谢|请咨询|请您|请向|建议您")


def _machine() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for no, held, gap in ((NOT_EN, WITHHELD_EN, " "), (NOT_ZH, WITHHELD_ZH, ""), (NOT_DE, WITHHELD_DE, " "), (NOT_FR, WITHHELD_FR, " "), (NOT_ES, WITHHELD_ES, " "), (NOT_RU, WITHHELD_RU, " ")):
        for n in no:
            for w in held:
                a.add_word(n + gap + w, True)
    for p in OUTRIGHT_EN:
        a.add_word(p, True)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def refusals() -> ahocorasick.Automaton:
    return _machine()


def refuses(text: str, share: float = REFUSED) -> bool:
    """Whether sentences that refuse, with their courtesies, make up at least ``share`` of the letters."""
    said = re.sub(r"[ \t]+", " ", text.lower().replace("’", "'"))
    if next(refusals().iter(said), None) is None:
        return False
    held = total = 0
    for m in SENTENCE.finditer(said):
        s = m[0]
        size = sum(map(str.isalnum, s))
        total += size
        if next(refusals().iter(s), None) is not None or COURTESY.search(s):
            held += size
    return held >= share * total


# --- ends ----------------------------------------------------------------------------------------------------

MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S)
CLOSE = {")": "(", "]": "[", "}": "{"}
ENVIRONMENT = re.compile(r"\\(begin|end)\{([^{}]*)\}")
ENDED = re.compile(r"(?:[.!?。！？;；:：…‥∎■□◻]|\b(?:QED|q\.e\.d|done|verified|hence proved))[\s\"'”’»」』）)\]*_`~$]*(?:(?:QED|q\.?e\.?d|∎|■|□)[.\s]*)?$", re.I)
#: Openings of a line that gives the final answer (fixed values).
ANSWER = re.compile(
    r"(?i)^\W*(?:step \d+\W+)?(?:(?:so|thus|hence|therefore|then|finally|and|in total)\b[,\s]*)*(?:the |our |my )?(?:final |correct |required |total )*(?:answer|result|solution|value|total|sum)\b(?: is| equals|\s*[:=]|\W*$)"
    r"|^\W*(?:(?:so|thus|hence|therefore|finally)\b[,\s]*)+(?:we |i |it )?(?:get|have|obtain|find|conclude|see|is|equals)\b|^\W*[a-zA-Z]\w?(?:\([^()]*\))?\s*=|^\W*(?:die |la |el |le )?(?:antwort|lösung|ergebnis|réponse|résultat|respuesta|resultado|solución|ответ|результат)\b"
    r"|^\W*(?:综上|即|所以|因此|故|于是)?[，,]?(?:最终|最后)?(?:答案|答[:：]|结果|所求|得解|解[:：])"
)
VALUE_END = re.compile(r"(?:[\d%°)}\]$]|\ue000|\\boxed\{.*\})[\s.。*_`]*$")
CODE = re.compile(r"^\s*(?:```|\||[-*•·]\s|\d+[.)]\s*$|</?\w|\\(?:end|begin|item)\b|(?:print|return|def|for|if|while)\b.*[\w)\]:]$|#{1,6} )")


def open_delimiters(text: str) -> list[str]:
    """Delimiters left open at the end: brackets, dollar signs and LaTeX environments, by stacks.

    Brackets inside a formula must close inside it; a formula that never closes leaves its dollar sign.
    Intervals such as ``[0, 1)`` may mix round and square brackets.
    """
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            if (m := ENVIRONMENT.match(text, i)) is not None:
                if m[1] == "begin":
                    stack.append("\\" + m[2])
                elif "\\" + m[2] in stack:
                    while stack.pop() != "\\" + m[2]:
                        pass
                i += len(m[0])
                continue
            i += 2
            continue
        if c == "$":
            mark = "$$" if text.startswith("$$", i) else "$"
            if mark in stack:
                while stack.pop() != mark:
                    pass
            elif mark == "$$" and "$" in stack:
                mark = "$"
                while stack.pop() != mark:
                    pass
            else:
                stack.append(mark)
            i += len(mark)
            continue
        if c in "({[":
            stack.append(c)
        elif c in CLOSE and stack:
            if stack[-1] == CLOSE[c] or (c in ")]" and stack[-1] in "(["):
                stack.pop()
        i += 1
    return stack


def breaks_off(text: str) -> bool:
    """Whether the text ends inside a sentence or a formula.

    Open formulas, braces and environments tell it, as does a last line of words that neither ends a sentence
    nor gives a final value. A line that is only a formula, a number, code, an item or a heading is no sentence.
    """
    body = visible(text).rstrip()
    last = body.split("\n")[-1].strip()
    if any(s.startswith(("$", "{")) for s in open_delimiters(last)):
        # a closing mark alone on the last line ends a formula that was opened before
        return bool(open_delimiters(body))
    if re.search(r"[,，、;；:：(（\[{+=<>*/\\^_&-]$", last) and not CODE.match(last):
        return True
    if ENDED.search(last):
        return False
    if any(s == "$$" or s[0] == "\\" for s in open_delimiters(body)):
        return not (ANSWER.search(last) and VALUE_END.search(last))
    plain = MATH.sub("\ue000", last)
    said = re.sub(r"\\boxed\{.*\}|\\[a-zA-Z]+|[\W\d_]+", " ", plain.replace("\ue000", " ")).split()
    if not said or CODE.match(last) or re.search(r"\\boxed\{.*\}\W*$", last):
        return False
    if ANSWER.search(plain) and VALUE_END.search(plain):
        return False
    return True


# --- languages -----------------------------------------------------------------------------------------------

#: Common short words of languages in Latin script (fixed values).
STOPWORDS = {
    "en": "a i the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no what up out into than them only its time some could these two may then do first any my now such like our over me even most after also did many before must through where much your way well down should because each just those how too between under both while same any every does shall let us find how".split(),
    "de": "der die das und ist nicht mit ein eine einer eines dem den des von zu auf für im sich auch als an es aus bei nach wir wird sind oder um dass wie aber nur noch hier dann wenn alle durch über kann so zum zur am beiden man daraus folgt gilt genau gibt keine kein werden wurde diese dieser insgesamt bleibt".split(),
    "fr": "le la les des du de et est une un dans que qui pour pas sur avec ce cette ces il elle on nous vous ils au aux en par plus se ne son sa ses leur mais ou où donc alors tout tous toutes cela encore reste faut entre deux première vaut sont être fait peut sans".split(),
    "es": "el la los las de del y es un una en que por para con no se su sus al lo como más pero o este esta estos estas hay entre ambos todo todos cuando donde muy también aquí dos sin sobre tiene puede desde hasta queda total hacen tomar según qué".split(),
    "it": "il lo la gli le di del della e è un una in che per con non si su al come più ma o questo questa sono tra quando anche due senza ogni tutto dal nel alla".split(),
    "pt": "o a os as de do da dos das e é um uma em que por para com não se seu sua ao como mais mas ou este esta são entre quando também dois sem cada todo pelo na no".split(),
    "nl": "de het een en van is niet met voor op te dat die in aan als zijn er om ook door maar bij uit nog wel naar dan deze dit worden wordt".split(),
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _list in STOPWORDS.items():
    for _w in _list:
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)
SCRIPTS = {"CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "CYRILLIC": "ru", "ARABIC": "ar", "HEBREW": "he", "GREEK": "el", "DEVANAGARI": "hi", "THAI": "th"}
ACCENTS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es"}


@lru_cache(maxsize=8192)
def script(ch: str) -> str:
    return SCRIPTS.get(unicodedata.name(ch, "").split(" ")[0], "")


def votes(text: str) -> tuple[Counter, float]:
    """How many words vote for each language, and how many vote at all.

    Formulas and commands have no vote. A common word of a language in Latin script votes for every language
    that has it; a letter of a script of one language is a fifth of a vote, a Han or Kana letter a half, an
    accented letter a fifth.
    """
    t = re.sub(r"\\[a-zA-Z]+|<[^<>\n]*>|https?://\S+", " ", MATH.sub(" ", text)).lower()
    told: Counter = Counter()
    total = 0.0
    met = Counter(re.findall(r"[^\W\d_]+", t))
    for w in met.keys() & _VOTES.keys():
        for lang in _VOTES[w]:
            told[lang] += met[w]
        total += met[w]
    if not t.isascii():
        letters: Counter = Counter()
        for w, n in met.items():
            if not w.isascii():
                for ch in w:
                    letters[ch] += n
        for ch, n in letters.items():
            lang = script(ch) if ord(ch) > 0x2FF else ACCENTS.get(ch)
            if lang:
                part = n * (0.5 if lang in ("zh", "ja", "ko") else 0.2)
                told[lang] += part
                total += part
    return told, total


def leading(told: Counter, total: float) -> tuple[str, float]:
    """The language with the most of the votes, and its share; ("", 0) where nothing votes."""
    if not told:
        return "", 0.0
    best, n = max(told.items(), key=lambda x: (round(x[1], 6), x[0] == "en", x[0]))
    return best, n / total


def language(text: str) -> tuple[str, float]:
    """The language most words vote for, and its share of the votes; ("", 0) where nothing votes."""
    return leading(*votes(text))


def other_language(prompt: str, response: str) -> bool:
    """Whether clear majorities put prompt and response into different languages, and few words fit the prompt's."""
    a, sure_a = language(prompt)
    told, total = votes(response)
    b, sure_b = leading(told, total)
    return bool(a and b) and a != b and sure_a >= 0.5 and sure_b >= 0.6 and told[a] < 0.5 * told[b]


def defect(prompt: str | None, response: str | None) -> str | None:
    """The one defect of a pair, or None; the first of empty, refusal, copy, language and truncated that holds.

    A null response is empty; a null prompt copies nothing and has no language.
    """
    r = visible(response or "")
    if not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Sm", "Sc", "So") for c in r):
        return "empty"
    if refuses(r):
        return "refusal"
    if prompt:
        share, new = copied(prompt, r)
        if share >= COPIED and new <= max(NEW_WORDS, NEW_SHARE * len(units(prompt))):
            return "copy"
        if other_language(prompt, r):
            return "language"
    return "truncated" if breaks_off(r) else None


def defects(pairs: DataFrame) -> DataFrame:
    """(gen_id, defect) of defective pairs (gen_id, question, continuation).

    Null ids give no row; a repeated id gives one row, by its defect first in the alphabet where copies differ.
    """
    kind = dict(pairs.dtypes)["gen_id"]

    def scan(ids: list, prompts: list, responses: list) -> list[tuple]:
        return [(i, d) for i, q, r in zip(ids, prompts, responses) if (d := defect(q, r))]

    whole = spread(pairs.select("gen_id", "question", "continuation").where("gen_id is not null"))
    return map_columns(whole, scan, f"gen_id {kind}, defect string").groupBy("gen_id").agg(F.min("defect").alias("defect"))
