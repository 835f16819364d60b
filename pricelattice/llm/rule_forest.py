"""Quality rules: an isolation forest over rule statistics of each text.

The statistics are computed once per text by the tasks that read it. The forest is the usual one:
each tree splits ``SUBSAMPLE`` rows at random features and values, and a text that few splits
isolate is anomalous. The rows of all trees are a fixed number, drawn over all documents by least
hash. The threshold on the anomaly score is the one that labelled rows say parts good from bad
best; a document is kept if it passes the base rules and stays below the threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, least_by_hash, stored

TREES = 128
SUBSAMPLE = 256
GOOD_WEIGHT = 3
#: Scores are counted to so many places for the threshold.
PLACES = 4
#: The definitions of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What the forest sees. Repeated lines and words are left to the base rules: most texts have none, so
#: that a forest isolates every text with a repeated footer (README has the figures).
FEATURES = ["symbol_share", "upper_share", "mark_share", "word_length"]
#: Shares are drawn to a usual value by so many words, so that short texts are not odd by chance.
PRIOR_WORDS, USUAL_UPPER, USUAL_MARK, USUAL_LENGTH = 20, 0.01, 0.17, 5
STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"{f} double" for f in FEATURES)
)


def _rank(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def repeat_words(words: list[str], size: int = WINDOW) -> int:
    """Words that stand in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    key, width = ids[:n], 1
    while width < size:  # exact names of ever longer runs
        key = _rank(key * len(known) + ids[width : width + n])
        width += 1
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """Base statistics and features of a whole text, in the order of STATS; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    letters = sum(map(str.isalpha, words))
    upper = sum(w.isupper() for w in words)
    m = max(n, 1)
    return (
        n, chars, symbols, dup, repeats,
        symbols / m,
        (upper + USUAL_UPPER * PRIOR_WORDS) / (n + PRIOR_WORDS),
        (n - letters + USUAL_MARK * PRIOR_WORDS) / (n + PRIOR_WORDS),
        (chars + USUAL_LENGTH * PRIOR_WORDS) / (n + PRIOR_WORDS),
    )


@lean
def _all_statistics(batches):
    names = [c.split()[0] for c in STATS.split(", ")]
    for batch in batches:
        rows = [statistics(t) for t in batch["text"]]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "id", batch["id"].to_numpy())
        yield out


class Forest:
    """Isolation trees as arrays: feature (-1: a leaf), split value, children, path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        self.size = min(subsample, len(rows))
        for _ in range(trees if len(rows) else 0):
            own = rows[rng.choice(len(rows), self.size, replace=False)]
            self.trees.append(self._grow(own, rng, int(np.ceil(np.log2(max(self.size, 2))))))

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean path length of an unsuccessful search among ``n`` rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng, depth: int):
        feature, value, left, right, length = [], [], [], [], []

        def node(own: np.ndarray, level: int) -> int:
            k = len(feature)
            for column, first in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (length, 0.0)):
                column.append(first)
            low, high = own.min(axis=0), own.max(axis=0)
            split = np.flatnonzero(high > low)
            if level == depth or not len(split):
                length[k] = level + self._mean_path(len(own))
                return k
            f = int(rng.choice(split))
            at = rng.uniform(low[f], high[f])
            side = own[:, f] < at
            if side.all() or not side.any():
                side = own[:, f] <= low[f]
                at = np.nextafter(low[f], np.inf)
            feature[k], value[k] = f, at
            left[k], right[k] = node(own[side], level + 1), node(own[~side], level + 1)
            return k

        node(rows, 0)
        return tuple(np.array(x) for x in (feature, value, left, right, length))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1; 0.5 without trees."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for feature, value, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = rows[everyone, np.maximum(f, 0)] < value[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self._mean_path(self.size), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut that parts good (below) from bad with the best balanced accuracy, in which good texts
    weigh GOOD_WEIGHT times as much, in the middle of the gap; above all scores if a kind is missing.
    ``good`` and ``bad`` count the texts of each of the distinct ``scores``."""
    if not good.sum() or not bad.sum():
        return 2.0
    order = np.argsort(scores)
    s = scores[order]
    kept_good = np.append(0, np.cumsum(good[order])) / good.sum()
    kept_bad = np.append(0, np.cumsum(bad[order])) / bad.sum()
    k = int(np.argmax(GOOD_WEIGHT * kept_good - kept_bad))
    return float(s[0] if k == 0 else s[-1] + 1e-9 if k == len(s) else (s[k - 1] + s[k]) / 2)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the base statistics, ``base_failed``, ``score`` (the
    anomaly score) and ``kept``.

    Null, empty and blank texts have no words and fail the base rules. Rows with a null id are judged
    as well. Repeated rows get equal results. Labels with a null are ignored; without labels of both
    kinds only the base rules reject. An empty table gives an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    stats = stored(plain.mapInPandas(_all_statistics, f"id {kind}, {STATS}"), "rule-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    usual = stats.where(~failed)
    drawn = least_by_hash(usual.select("id", *FEATURES), TREES * SUBSAMPLE, ["id", *FEATURES]).select(*FEATURES).toPandas()
    forest = Forest(drawn.to_numpy(np.float64))
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.column_stack([c.to_numpy(np.float64) for c in columns])))

    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    marked = (
        usual.join(known, "id")
        .groupBy(F.round(anomaly(*FEATURES), PLACES).alias("score"))
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
        .toPandas()  # a row for each score that occurs, 10**PLACES + 1 at most
    )
    cut_at = threshold(marked["score"].to_numpy(), marked["good"].to_numpy(), marked["bad"].to_numpy())

    return (
        stats.withColumn("base_failed", failed)
        .withColumn("score", anomaly(*FEATURES))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(cut_at)))
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"
        )
    )
