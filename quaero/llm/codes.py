"""Texts as numpy arrays of code points, for tasks that look at every character."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20  # characters looked at together; bounds the arrays of a very long text
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=None)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, is it white space."""
    every = range(sys.maxunicode + 1)
    letter = np.fromiter((chr(c).isalpha() for c in every), bool, len(every))
    space = np.fromiter((chr(c).isspace() for c in every), bool, len(every))
    return letter, space


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_pieces(text: str) -> Iterator[str]:
    """The text in pieces that are cut at white space, so that every word lies in one."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def words_only(text: str) -> np.ndarray:
    """Lower-case letters, any other run as one blank, with a blank at both ends; empty without letters."""
    codes = points(text.lower())
    letter = kinds()[0][codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, codes, np.uint32(32))[keep]
    return np.concatenate(([np.uint32(32)], out, [] if out[-1] == 32 else [np.uint32(32)])).astype(np.uint32)
