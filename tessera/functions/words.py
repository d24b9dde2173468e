"""Words of a text, as matching and counting operators need them."""

from __future__ import annotations

import re

#: Characters that do not show: soft hyphen, zero-width marks, direction marks, joiners, byte-order mark, variation selectors.
HIDDEN_RANGES = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB)]
HIDDEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HIDDEN_RANGES) + "]")
#: Code points of Unicode white space.
SPACES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WORD = re.compile(r"[^\W_]+")
HAN_RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
HAN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN_RANGES) + "]")


def visible(text: str) -> str:
    """The text without characters that do not show."""
    return text if text.isascii() else HIDDEN.sub("", text)


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; hidden characters are dropped first."""
    return WORD.findall(visible(text).lower())


def mostly_han(text: str) -> bool:
    """Whether Han characters outnumber the words written in other scripts."""
    if text.isascii():
        return False
    han = len(HAN.findall(text))
    return han > 0 and han > len(WORD.findall(HAN.sub(" ", text)))
