"""Texts as small character classes, for character n-gram models.

Class 0 is everything but letters (a word boundary), 1 to 26 are a to z, and
the other letters share the classes from 27 by code point.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CLASSES = 64


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x250):  # Latin; other scripts by the rule below
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            t[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CLASSES - 27)
    rest = np.arange(0x250, 0x110000)
    t[0x250:] = np.where((rest >= 0x2000) & (rest < 0x2C00), 0, 27 + rest % (CLASSES - 27))  # punctuation and symbols: none
    return t


def classes(text: str) -> np.ndarray:
    """Class of each code point; a lone surrogate counts as no letter."""
    return _table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]


def letter_class(c: str) -> int:
    return int(_table()[ord(c)])


def trigrams(text: str) -> np.ndarray:
    """Codes below CLASSES ** 3 of the trigrams of boundary + text + boundary; runs of boundaries count once."""
    c = np.concatenate([[0], classes(text), [0]]).astype(np.int64)
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
