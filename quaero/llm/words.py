"""Words of whole texts as Arrow arrays, a bounded number of characters at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quaero.llm import codes

PART = 1 << 21  # characters split together


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, from its bytes alone."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(ends)
    data = words.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    place = np.arange(len(letters)) - np.repeat(ends[:-1] - ends[0], size)
    scrambled = codes.mix(letters.astype(np.uint64) + ((place + 1).astype(np.uint64) << np.uint64(32)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled, dtype=np.uint64)))
    at = ends - ends[0]
    return codes.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64))


def parts(text: str, cut: re.Pattern, limit: int = PART) -> Iterator[str]:
    """The text in parts that end behind a match of ``cut``, as soon as one follows the limit."""
    at = 0
    while at < len(text):
        found = cut.search(text, at + limit) if at + limit < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def bundles(texts: list[str], cut: re.Pattern, limit: int = PART) -> Iterator[list[tuple[int, str, bool]]]:
    """(number of the text, part of it, is it the last part) in lists of about ``limit`` characters."""
    held: list[tuple[int, str, bool]] = []
    size = 0
    for i, text in enumerate(texts):
        done = 0
        for part in parts(text, cut, limit):
            done += len(part)
            held.append((i, part, done == len(text)))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def split(texts: list[str], kind: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each word, the words, marks before it) of texts that are apart.

    ``kind`` tells of each byte of UTF-8 whether it is of a word (0), between words (1) or a mark
    between words (2); ``lower`` is what it becomes.  The last count of marks is that of all.
    """
    data = [t.encode() for t in texts]
    size = np.cumsum([len(d) for d in data], dtype=np.int64) if data else np.empty(0, np.int64)
    whole = np.frombuffer(b"".join(data), np.uint8)
    kinds = kind[whole]
    inside = kinds == 0
    padded = np.zeros(len(whole) + 1, bool)
    padded[:-1] = inside
    starts = np.flatnonzero(inside & ~np.concatenate((np.zeros(1, bool), inside[:-1]))) if len(whole) else np.empty(0, np.int64)
    ends = np.flatnonzero(padded[:-1] & ~padded[1:]) + 1
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(lower[whole[inside]]))
    marks = np.concatenate((np.zeros(1, np.int64), np.cumsum(kinds == 2)))
    return np.searchsorted(size, starts, side="right"), found, np.append(marks[starts], marks[-1])


def table(**of: bytes) -> np.ndarray:
    """A table over all bytes: the number of the group that a byte is in, 0 for none."""
    out = np.zeros(256, np.uint8)
    for i, group in enumerate(of.values(), 1):
        out[list(group)] = i
    return out


# A–Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
