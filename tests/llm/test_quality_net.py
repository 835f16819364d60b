import random

import numpy as np
import pandas as pd

from pricelattice.llm import quality_net as Q
from pricelattice.llm.word_hash import exact_hashes
from pyspark.sql import functions as F

from pricelattice.llm.queries import op10_quality
from pricelattice.llm.quality_net import score_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_edges(spark):
    docs = "doc_id long, text string, score string, quality int"
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(spark.createDataFrame([], docs), labels).collect() == []
    rows = [(1, "a b c", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (3, "", "x", 1), (None, "w " * 90_000, None, None)]
    none = labels.where(F.lit(False))
    for known in (labels, none):
        got = score_quality(spark.createDataFrame(rows, docs), known).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert all(abs(r.score - 0.5) < 1e-9 for r in got)


def test_vectors_and_pooling_by_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(40)] + [None, "", " \n"]
    index = Q.index_vectors().astype(float)
    bucket = lambda w: int(exact_hashes([w])[0][0] % np.uint64(Q.BUCKETS))
    want = np.zeros((Q.BUCKETS, Q.DIM))
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(max(0, i - Q.REACH), min(len(w), i + Q.REACH + 1)):
                if i != j:
                    want[bucket(w[i])] += index[bucket(w[j])]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(norm > 0, norm, 1)
    got = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want, atol=1e-6)
    pooled = Q._pool(pd.Series([t for t in texts]), got, Q.index_vectors())
    for t, row in zip(texts, pooled, strict=True):
        b = [bucket(w) for w in (t or "").split()]
        if not b:
            assert not row.any()
            continue
        near = sum((index[x] * index[y] for x, y in zip(b, b[1:])), np.zeros(Q.DIM)) / len(b)
        assert np.allclose(row, np.concatenate([want[b].mean(axis=0), want[b].std(axis=0), near, [np.log1p(len(b)) / 10]]), atol=1e-3)
