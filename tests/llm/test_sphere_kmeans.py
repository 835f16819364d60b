import hashlib

import numpy as np
import pytest

from pricelattice.llm.sphere_kmeans import cluster, lower_drift


def brute(ids, x, k, rounds, salt="3:", scale=1024):
    """Lloyd's rounds with Python's whole numbers."""
    v = np.floor(scale * np.asarray(x, float)).astype(np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{salt}{ids[i]}".encode()).hexdigest(), v[i].astype("<i4").tobytes()))
    c = v[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (near == j).any():
                    own = v[near == j]
                    c[j] = own.sum(axis=0) // len(own)
    inertia = np.bincount(near, weights=d.min(axis=1), minlength=len(c)).astype(int)
    names = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c.tolist()]
    return sorted((str(ids[i]), int(near[i]), int(d[i].min()), int(inertia[near[i]]), int(inertia.sum()), names[near[i]]) for i in range(len(ids)))


def got(frame):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in frame.collect())


@pytest.mark.parametrize("seed, n, dims, k", [(1, 700, 5, 8), (2, 9000, 3, 8), (3, 40, 64, 8), (4, 5, 4, 8), (5, 300, 2, 12)])
def test_as_brute_force(spark, seed, n, dims, k):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(k, dims))
    x = (middle[rng.integers(0, k, n)] + 0.4 * rng.normal(size=(n, dims))).astype(np.float32)
    x[: n // 4] = np.round(x[: n // 4])  # ties and equal vectors
    ids = [int(i) for i in rng.permutation(n)]
    rows = spark.createDataFrame([(i, y.tolist()) for i, y in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    seen = []
    assert got(cluster(rows, k=k, dims=dims, seen=seen)) == brute(ids, x.astype(float), k, 10)
    assert len(seen) == 11 and seen[0] == n
    if n == 9000:
        assert sum(seen[1:]) < 10 * n / 3  # most vectors are settled by their bounds


def test_bound_holds_and_is_under_the_drift():
    rng = np.random.default_rng(7)
    tighter = 0
    for _ in range(300):
        dims, k = rng.integers(2, 6), 4
        old = rng.normal(size=(k, dims)) * 10
        new = old + rng.normal(size=(k, dims)) * rng.choice([0, 0.01, 1, 20], size=(k, 1))
        radius = rng.random(k) * rng.choice([0.1, 5, 40])
        bound, size = lower_drift(old, new, radius), np.linalg.norm(new - old, axis=1)
        for i in range(k):
            way = rng.normal(size=(400, dims))
            x = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.random((400, 1)) ** 0.2
            lost = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (lost <= bound[i] + 1e-9).all()
        assert (bound <= size * (1 + 1e-8)).all()
        tighter += (bound < 0.9 * size).sum()
    assert tighter > 300


def test_edges(spark):
    good = [float(k) for k in range(64)]
    rows = [(1, good, "a"), (1, good, "a"), (None, [0.5] * 64, "b"), (2, None, "c"), (3, good[:63], "d"), (4, [None, *good[1:]], "e"),
            (5, [float("nan"), *good[1:]], "f"), (6, [float("inf"), *good[1:]], "g"), (7, [-0.0001] * 64, "h"), (8, [], "i")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    ids, x = [1, 1, None, 7], [good, good, [0.5] * 64, [-0.0001] * 64]
    assert got(cluster(table)) == brute(ids, x, 8, 10)
    assert cluster(table.where("false")).columns == cluster(table).columns
    assert cluster(table.where("vec_id = 3")).count() == 0
    named = table.selectExpr("concat('n', vec_id) AS vec_id", "embedding")
    assert cluster(named).count() == 4
    with pytest.raises(Exception, match="do not fit"):
        cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_query_is_brute_force(spark):
    from pricelattice.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = [r for r in rows if r.embedding is not None and len(r.embedding) == 64 and all(y is not None and np.isfinite(y) for y in r.embedding)]
    assert got(QUERIES["op13_sphere_kmeans"](spark, sf)) == brute([r.vec_id for r in kept], [r.embedding for r in kept], 8, 10)
