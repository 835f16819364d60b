"""String similarity, 0 to 100, as Arrow functions: twice the longest common subsequence over the
total length, plain or over sorted words or over word sets."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if m := places.get(c, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """Best of the three comparisons of what both have and what each has beside; 100 if one holds the
    other, 0 if either is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, x - y, y - x
    if both and (not left or not right):
        return 100.0
    base = " ".join(sorted(both))
    one = " ".join([*filter(None, [base]), *sorted(left)])
    two = " ".join([*filter(None, [base]), *sorted(right)])
    return max(ratio_of(one, two), ratio_of(base, one) if base else 0.0, ratio_of(base, two) if base else 0.0)


def _words(name: str) -> str:
    return " ".join(sorted(set(name.split())))


class NameIndex:
    """Names ``(ordinal, normalised, ...)`` by their words and numbered characters, for the best ones by token-set ratio.

    The words that two names share make a base of b characters; with lengths l1 and l2 (each word once) its comparisons give 2b / (b + l) exactly,
    and that of the whole names 2o / (l1 + l2) at most, where o is the number of characters they have in common in any order."""

    def __init__(self, names: list[tuple]):
        self.names = [n[1] for n in names]
        self.order = np.argsort(np.array([n[0] for n in names], np.int64), kind="stable")
        self.rank = np.empty(len(names), np.int64)
        self.rank[self.order] = np.arange(len(names))
        self.place: dict[str, np.ndarray] = {}
        lists: dict[str, list[int]] = {}
        columns: dict[tuple[str, int], int] = {}
        cells = []
        self.size = np.array([len(_words(n)) for n in self.names], float)
        for k, n in enumerate(self.names):
            for w in set(n.split()):
                lists.setdefault(w, []).append(k)
            cells += [(k, columns.setdefault(c, len(columns))) for c in self._characters(_words(n))]
        self.words = {w: np.array(ks) for w, ks in lists.items()}
        self.columns = columns
        self.has = np.zeros((len(columns), len(names)), np.float32)
        if cells:
            rows, cols = np.array(cells).T
            self.has[cols, rows] = 1

    @staticmethod
    def _characters(words: str) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        out = []
        for c in words:
            seen[c] = seen.get(c, 0) + 1
            out.append((c, seen[c]))
        return out

    def bounds(self, title: str) -> np.ndarray:
        """At most the ratio of every name."""
        own = _words(title)
        known = [self.columns[c] for c in self._characters(own) if c in self.columns]
        out = 200.0 * self.has[known].sum(axis=0) / np.maximum(len(own) + self.size, 1)
        base, shared = np.zeros(len(self.names)), np.zeros(len(self.names))
        for w in set(title.split()):
            if w in self.words:
                base[self.words[w]] += len(w)
                shared[self.words[w]] += 1
        met = np.flatnonzero(shared)
        b = base[met] + shared[met] - 1
        out[met] = np.maximum(out[met], 200.0 * b / (b + np.minimum(len(own), self.size[met])))
        return out

    def best(self, title: str, top: int) -> tuple[list[tuple[int, float]], int]:
        """The ``top`` names as (index, ratio), least ordinal on ties, and how many were compared in full."""
        bound = self.bounds(title)
        first = np.lexsort((self.rank, -bound))
        found: list[tuple[float, int, int]] = []
        scored = 0
        for k in first.tolist():
            if len(found) >= top and bound[k] + 1e-6 < -found[top - 1][0]:
                break
            insort(found, (-token_set_of(title, self.names[k]), int(self.rank[k]), k))
            del found[top:]
            scored += 1
        return [(k, -s) for s, _, k in found], scored


def _arrow(of):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else of(x, y) for x, y in zip(a, b)], dtype="float64")

    return score


ratio, token_sort_ratio, token_set_ratio = _arrow(ratio_of), _arrow(token_sort_of), _arrow(token_set_of)
