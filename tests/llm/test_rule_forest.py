import random
import re
from collections import Counter

import numpy as np

from pricelattice.llm.queries import op2_rule_forest
from pricelattice.llm.rule_forest import Forest, judged, least_by_hash, repeat_words, statistics, threshold


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_repeat_words():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(30))]
        assert repeat_words(words) == brute(" ".join(words))[4]


def test_path_lengths_by_walking_the_trees():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 3))
    forest = Forest(rows, trees=7, subsample=64)
    for row, got in zip(rows[:50], forest.score(rows[:50])):
        total = 0.0
        for feature, value, left, right, length in forest.trees:
            k = 0
            while feature[k] >= 0:
                k = left[k] if row[feature[k]] < value[k] else right[k]
            total += length[k]
        assert abs(got - 2 ** (-total / 7 / Forest._mean_path(64))) < 1e-12
    assert forest.score(np.array([[9.0, 9.0, 9.0]]))[0] > forest.score(np.zeros((1, 3)))[0]


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(4)
    for _ in range(100):
        s = np.sort(rng.choice(50, 12, replace=False)) / 50
        good, bad = rng.integers(0, 5, 12), rng.integers(0, 5, 12)
        if good.sum() and bad.sum():
            gain = lambda c: 3 * good[s < c].sum() / good.sum() - bad[s < c].sum() / bad.sum()
            assert abs(gain(threshold(s, good, bad)) - max(map(gain, [*s, 2.0]))) < 1e-12
    assert threshold(np.array([0.1]), np.array([3]), np.array([0])) == 2.0


def test_odd_texts_are_isolated(spark):
    """Long words and shouts score above most good texts, though the forest grows on good and bad ones."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    rows = [(r.quality, statistics(r.text)[5:]) for r in docs.collect() if r.text and len(r.text) > 200]
    forest = Forest(np.array([x for _, x in rows]))
    good = forest.score(np.array([x for q, x in rows if q == 1]))
    odd = [" ".join(["x" * 300] * 3 + ["a"] * 60), "### " * 60, "SHOUTING LOUD " * 30]
    assert forest.score(np.array([statistics(t)[5:] for t in odd])).min() > np.quantile(good, 0.95)


def test_draw(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "a")
    assert least_by_hash(rows, 10_000, ["a"]).count() == 5_000 and least_by_hash(rows, 100, ["a"]).count() == 100


def test_held_out_labels(spark):
    """The threshold from half of the labels keeps good and rejects bad documents of the other half."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in judged(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0")).collect() if not r.base_failed]
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op2_rule_forest(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    judged_rows = [r for r in rows if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in judged_rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in judged_rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_edges(spark):
    schema = "doc_id long, text string, score string, n_words string"
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None, "x", None), (2, "", "x", None), (2, "", "x", None), (3, "a b c d e f g h i j k", "x", "y"), (None, "w " * 60_000, None, None)]
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in judged(spark.createDataFrame(rows, schema), labels).collect()}
    assert got == {(1, 0, True, False), (2, 0, True, False), (3, 11, False, True), (None, 60_000, True, False)}
    assert judged(spark.createDataFrame([], schema), labels).collect() == []
