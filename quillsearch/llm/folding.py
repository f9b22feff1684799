"""Homoglyphs: one code point to one, so that character offsets stay as they are."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

_PAIRS = {
    "a": "аɑαᴀ", "b": "ЬʙвВ", "c": "сϲᴄС", "d": "ԁᴅ", "e": "еєεᴇЕ", "f": "ғꜰ", "g": "ɡԍɢ", "h": "һнʜН", "i": "іɩιıᴉІΙ",
    "j": "јϳᴊЈ", "k": "кκᴋКΚ", "l": "ӏʟ", "m": "мᴍМΜ", "n": "пηɴΝ", "o": "оοσᴏОΟ", "p": "рρᴘРΡ", "q": "ԛ", "r": "гʀ",
    "s": "ѕꜱЅ", "t": "тτᴛТΤ", "u": "υսᴜ", "v": "ѵνᴠ", "w": "ѡԝᴡω", "x": "хχХΧ", "y": "уүγʏУΥ", "z": "ᴢΖ",
}


@cache
def homoglyphs() -> np.ndarray:
    """For each code point the one it is read as: full width, mathematical and circled forms, and look-alikes from other scripts."""
    t = np.arange(0x110000, dtype=np.uint32)
    for lo, hi in ((0x2070, 0x2190), (0x2460, 0x2500), (0xFF01, 0xFFE0), (0x1D400, 0x1D800), (0x1F100, 0x1F190)):
        for c in range(lo, hi):
            n = unicodedata.normalize("NFKC", chr(c))
            if len(n) == 1 and n.isascii():
                t[c] = ord(n)
    for latin, likes in _PAIRS.items():
        for c in likes:
            t[ord(c)] = ord(latin.upper() if c.isupper() else latin)
    return t


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def string(points: np.ndarray) -> str:
    return points.astype(np.uint32, copy=False).tobytes().decode("utf-32-le", "surrogatepass")
