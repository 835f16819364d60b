"""Hashes of all words of many texts at once, without a Python object per word."""

from __future__ import annotations

import re

import numpy as np

#: What stands between words: ASCII but for letters and digits.
_BETWEEN = re.compile(r"[\x00-/:-@\[-`{-\x7f]+")
_IS_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: The white space of the word definition `[^\\x20\\x09-\\x0D]+` alone.
_IS_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes with A-Z in lower case.
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15
#: Characters of text handled at once.
STEP = 1 << 18


def plain_words(text: str | None) -> list[str]:
    """Lower-cased words; none for null. ASCII white space and punctuation separate words."""
    return [w for w in _BETWEEN.split((text or "").lower()) if w]


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (as ``plain_words`` cuts them) of ``texts``, and the number of words
    of each: a polynomial in the bytes of each word, by differences of one running sum."""
    return _hashed([t.lower().encode() for t in texts], _IS_BETWEEN, False)


def space_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for words between white space, A-Z in lower case."""
    return _hashed([t.encode() for t in texts], _IS_SPACE, True)


def exact_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for words between white space as they are."""
    return _hashed([t.encode() for t in texts], _IS_SPACE, False)


def _hashed(parts: list[bytes], is_between: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    data = _LOWER[data] if lower else data
    between = is_between[data]
    starts = np.flatnonzero(between[:-1] & ~between[1:])  # the byte before each word
    ends = np.flatnonzero(~between[:-1] & between[1:])
    up, down = _Powers.of(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)
    hashed = (total[ends] - total[starts]) * down[starts] * np.uint64(0xD6E8FEB86659FD93)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return hashed ^ (hashed >> np.uint64(32)), np.diff(np.searchsorted(starts, np.append(0, bounds)))


def runs(texts):
    """Whole texts of about STEP characters together, those without a word left out: (place of each
    text, hashes of all their words, number of words of each)."""
    rows: list[int] = []
    parts: list[str] = []
    total = 0

    def done():
        hashes, n = word_hashes(parts)
        if len(hashes):
            yield np.array(rows)[n > 0], hashes, n[n > 0]

    for row, text in enumerate(texts):
        if text:
            rows.append(row)
            parts.append(text)
            total += len(text)
        if total >= STEP:
            yield from done()
            rows, parts, total = [], [], 0
    if parts:
        yield from done()
