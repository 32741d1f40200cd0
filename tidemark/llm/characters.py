"""Characters as the tokenizers library sees them, where the installed Unicode tables of Python know more or less.

Below ``OLD`` all tables agree, so only texts with a character from there on need what is here.
"""

from __future__ import annotations

import unicodedata

import regex
from tokenizers import normalizers

OLD = "\u0558"
#: Every character from ``OLD`` on has a byte from this on in UTF-8.
OLD_BYTE = 0xD5

# What the regex module calls a letter or a number and the library calls neither, first and last of each run.
NEITHER = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEITHER = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in NEITHER)
LETTER, NUMBER = rf"[\p{{L}}--[{_NEITHER}]]", rf"[\p{{N}}--[{_NEITHER}]]"
_LOWER, _COMPOSE = normalizers.Lowercase(), normalizers.NFC()


def other(space: str) -> str:
    """A pattern of what is no letter, number or white space."""
    return rf"(?:[^{space}\p{{L}}\p{{N}}]|[{_NEITHER}])"


def is_old(text: str) -> bool:
    return text.isascii() or max(text) < OLD


def lower_old(text: str) -> str:
    """Lower case, character by character, of a text without characters from ``OLD`` on."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def lower(text: str) -> str:
    """Lower case, character by character."""
    return lower_old(text) if is_old(text) else _LOWER.normalize_str(text)


def composed(text: str) -> str:
    """NFC."""
    return unicodedata.normalize("NFC", text) if is_old(text) else _COMPOSE.normalize_str(text)


def cutter(pattern: str, space: str) -> regex.Pattern:
    """A pattern in which ``LETTER``, ``NUMBER`` and ``OTHER`` stand for the library's classes."""
    return regex.compile("(?V1)" + pattern.replace("LETTER", LETTER).replace("NUMBER", NUMBER).replace("OTHER", other(space)))
