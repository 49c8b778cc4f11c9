"""Character classes and the pre-tokenisation pattern of the byte-level vocabularies, in Python's fast ``re``.

The tokenizer libraries follow Unicode 16; Python's own tables are of an older version.  What version 16 added to letters,
numbers and lower-case mappings is stated here, so that the classes are the same for every code point (a test tries all).
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: Unicode White_Space, and the contraction alternatives of the published patterns.
SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters and numbers that Unicode 16 added (first, last), in code point order.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Lower-case mappings newer than Python's tables, as (first, last, first mapped to).
NEW_LOWER = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]

_SPACES = re.compile(f"[{SPACE}]")
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_LOWER = {a + k: to + k for a, b, to in NEW_LOWER for k in range(b - a + 1)}
_NEW_CAPITALS = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def kind(c: str) -> str:
    """Of one character: L letter, N number, S blank, O other."""
    major = unicodedata.category(c)[0]
    if major in "LN":
        return major
    if _SPACES.match(c):
        return "S"
    if major == "C":  # perhaps newer than the tables
        for name, added in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
            if any(a <= ord(c) <= b for a, b in added):
                return name
    return "O"


def lower(text: str) -> str:
    """Lower case one character at a time: str.lower looks around a final sigma."""
    out = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
    return out.translate(_LOWER) if not out.isascii() and _NEW_CAPITALS.search(out) else out


@cache
def _class(name: str, end: int) -> str:
    """The ranges of class ``name`` below code point ``end``."""
    inside = bytearray(end + 1)
    for c in range(end):
        inside[c] = unicodedata.category(chr(c))[0] == name
    for a, b in NEW_LETTERS if name == "L" else NEW_NUMBERS:
        for c in range(a, min(b + 1, end)):
            inside[c] = 1
    edges = [c for c in range(end + 1) if inside[c] != (inside[c - 1] if c else 0)]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


@cache
def _byte_level(end: int) -> re.Pattern:
    letter, number = _class("L", end), _class("N", end)
    return re.compile(f"{CONTRACTION}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_level(text: str) -> re.Pattern:
    """The pre-tokens of the byte-level vocabularies: contractions, then runs of one class with a blank before them.

    Two forms of one pattern: without the classes beyond the first 65,536 code points, which ``re`` tries one by one, for
    texts that have none of those.
    """
    return _byte_level(0x110000 if not text.isascii() and _WIDE.search(text) else 0x10000)
