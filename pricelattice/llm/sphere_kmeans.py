"""Lloyd's clustering of integer vectors, sped up by geometric drift tightening, with exact results.

A vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to every
other one. When centroids move, the upper bound grows by the own centroid's drift. A lower bound must shrink by what any
vector of the cluster can have lost: all of them lie in a sphere around the old centroid. If centroid c moves to c', by D,
a vector x comes nearer by 2 D <x - m, u> / (|x - c| + |x - c'|) with the middle m and the direction u of the move, which is
D cos(angle of x - m and u) at most. Seen from m the sphere fills a cone, so that in the plane of m, u and the sphere's
centre the bound is D cos(angle of the centre less the cone's half angle): D itself only if the sphere reaches the axis of
the move, nothing if it lies behind the middle. A vector whose upper bound stays under all of its lower bounds stays; the
others are ambiguous: their own distance is computed, and if need be all of them, exactly in whole numbers.

Vectors travel in blocks, one row a block, with their bounds. A round is one pass over the blocks, kept on disk until the next one
stands; what goes to the driver is the sums, counts and radii of the clusters. A lost executor's blocks are made
again from the stored first ones by the same narrow steps."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored

#: Vectors of a block, and the greatest component (so that squared distances fit in 64 bits).
BLOCK, GREATEST = 4096, 1 << 27


def _bound(x: np.ndarray, to: float) -> np.ndarray:
    """Rounded to 32 bits away from the true value, in the direction ``to``."""
    return np.nextafter(x.astype(np.float32), np.float32(to))


def lower_drift(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster i and centroid j at most how much nearer j's move can have come to a vector within ``radius[i]`` of the
    old centroid i; never over the move itself."""
    move = new - old
    size = np.linalg.norm(move, axis=1)
    out = np.zeros((len(old), len(old)))
    for j in np.flatnonzero(size):
        arm = old - (old[j] + new[j]) / 2
        far = np.linalg.norm(arm, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(arm @ (move[j] / size[j]) / far, -1, 1))
            cone = np.arcsin(np.clip(radius / far, 0, 1))
        near = np.where(radius >= far, 1.0, np.maximum(np.cos(np.clip(angle - cone, 0, np.pi)), 0.0))
        out[:, j] = np.minimum(size[j], size[j] * (near + 1e-6)) * (1 + 1e-9)
    return out


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors to each centroid."""
    return np.stack([np.square(v - c).sum(axis=1) for c in centroids], axis=1)


def _rescan(v, centroids, near, upper, lower, rows):
    """Exact distances of ``rows`` to all centroids; the first of the nearest ones is theirs."""
    for lo in range(0, len(rows), 1024):
        own = rows[lo : lo + 1024]
        d = squared(v[own], centroids)
        near[own] = d.argmin(axis=1)
        root = np.sqrt(d.astype(np.float64))
        upper[own], lower[own] = _bound(root.min(axis=1), np.inf), _bound(root, -np.inf)


def moved(v, near, upper, lower, old, new, radius) -> int:
    """One assignment in place, from the bounds at ``old`` centroids; returns how many vectors were scanned."""
    k = np.arange(len(near))
    size = np.linalg.norm((new - old).astype(np.float64), axis=1) * (1 + 1e-9)
    upper[:] = _bound(upper.astype(np.float64) + size[near], np.inf)
    lower[:] = _bound(lower.astype(np.float64) - lower_drift(old.astype(np.float64), new.astype(np.float64), radius)[near], -np.inf)
    lower[k, near] = np.inf  # the own centroid is bounded from above
    floor = lower.min(axis=1)
    doubt = np.flatnonzero(upper >= floor)
    if len(doubt):
        exact = np.sqrt(np.square(v[doubt] - new[near[doubt]]).sum(axis=1).astype(np.float64))
        upper[doubt] = _bound(exact, np.inf)
        doubt = doubt[upper[doubt] >= floor[doubt]]
        _rescan(v, new, near, upper, lower, doubt)
    return len(doubt)


def _totals(v, near, upper, k: int) -> np.ndarray:
    """Sums of components, counts and radii (rounded up) of the clusters of a block, one after the other."""
    sums = np.stack([v[near == j].sum(axis=0) for j in range(k)])
    far = [int(np.ceil(upper[near == j].max())) if (near == j).any() else 0 for j in range(k)]
    return np.concatenate([sums.ravel(), np.bincount(near, minlength=k), far]).astype(np.int64)


def _whole(lists: pa.Array, dims: int, scale: float):
    """Which rows are vectors of ``dims`` finite components, and these as whole numbers."""
    good = np.asarray(pc.fill_null(pc.list_value_length(lists), -1)) == dims
    rows = np.flatnonzero(good)
    flat = pc.list_flatten(lists.take(pa.array(rows))).cast(pa.float64())
    x = np.asarray(pc.fill_null(flat, np.nan)).reshape(-1, dims)
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[fine])
    if x.size and np.abs(x).max() > GREATEST:
        raise ValueError(f"components over {GREATEST}: their squared distances do not fit in 64 bits")
    return rows[fine], x.astype(np.int32)


def _pack(id_col: str, vector: str, dims: int, scale: float):
    @lean
    def run(batches):
        for batch in batches:
            rows, x = _whole(batch.column(vector), dims, scale)
            ids = batch.column(id_col).take(pa.array(rows))
            for lo in range(0, len(rows), BLOCK):
                own = ids[lo : lo + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([x[lo : lo + BLOCK].tobytes()], pa.binary())], names=["ids", "v"]
                )

    return run


def _read(row: dict, dims: int, k: int):
    v = np.frombuffer(row["v"], np.int32).reshape(-1, dims).astype(np.int64)
    if "near" not in row:
        return v, np.zeros(len(v), np.uint8), np.zeros(len(v), np.float32), np.zeros((len(v), k), np.float32)
    lower = np.frombuffer(row["lower"], np.float32).reshape(-1, k).copy()
    return v, np.frombuffer(row["near"], np.uint8).copy(), np.frombuffer(row["upper"], np.float32).copy(), lower


def _round(dims: int, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None):
    """An assignment of all blocks: from nothing (``old`` is None), or from the bounds at the old centroids."""

    @lean
    def run(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                own = batch.slice(lo, 1)
                row = {c: own.column(c)[0].as_py() for c in own.schema.names if c in ("v", "near", "upper", "lower")}
                v, near, upper, lower = _read(row, dims, len(new))
                if old is None:
                    _rescan(v, new, near, upper, lower, np.arange(len(v)))
                    scanned = len(v)
                else:
                    scanned = moved(v, near, upper, lower, old, new, radius)
                totals = _totals(v, near, upper, len(new))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("ids"), own.column("v"), *[pa.array([x.tobytes()], pa.binary()) for x in (near, upper, lower)],
                        pa.ListArray.from_arrays(pa.array([0, len(totals) + 1], pa.int32()), pa.array(np.append(totals, scanned))),
                    ],
                    names=["ids", "v", "near", "upper", "lower", "totals"],
                )

    return run


def _result(dims: int, centroids: np.ndarray):
    @lean
    def run(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                v, near, _, _ = _read({c: batch.column(c)[lo].as_py() for c in ("v", "near", "upper", "lower")}, dims, len(centroids))
                d = np.square(v - centroids[near]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(lo, 1).flatten(), pa.array(near.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def _summed(blocks: DataFrame, k: int, dims: int):
    """Sums, counts and radii of all blocks, and the number of vectors scanned: k * (dims + 2) + 1 numbers."""
    parts = blocks.select(F.posexplode("totals").alias("place", "x"))
    rows = parts.groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.max("x").alias("most")).collect()
    total, most = {r.place: int(r.total) for r in rows}, {r.place: int(r.most) for r in rows}
    sums = [[total[j * dims + d] for d in range(dims)] for j in range(k)]
    counts = [total[k * dims + j] for j in range(k)]
    return sums, counts, np.array([most[k * dims + k + j] for j in range(k)], float), total[k * dims + 2 * k]


def first_centroids(blocks: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The k vectors of least SHA-256 of ``salt`` and id (null ids last), ties by their bytes."""
    width = 4 * dims
    rows = blocks.select("v", F.posexplode("ids").alias("place", "id"))
    own = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256).alias("h"), F.expr(f"substring(v, place * {width} + 1, {width})").alias("x"))
    least = own.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()  # k vectors
    return np.array([np.frombuffer(r.x, np.int32) for r in least], np.int64).reshape(-1, dims)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, salt: str = "3:",
    id_col: str = "vec_id", vector: str = "embedding", seen: list[int] | None = None,
) -> DataFrame:
    """One row per kept vector: ``id_col``, ``cluster``, ``distance`` (squared, to its final centroid), ``cluster_inertia``,
    ``inertia``, ``centroid_sha256``.

    Kept are vectors of ``dims`` components, none of them null or not finite; component x counts as floor(scale * x). The first
    centroids are the ``k`` (256 at most) of least SHA-256 of ``salt`` and id, fewer if fewer are kept. ``rounds`` times each vector goes to
    the nearest centroid (the first of several) and each centroid with vectors becomes the floor of their mean; then they are assigned once more.

    Repeated rows are vectors of their own; a null id is an id like any other, chosen last as a centroid. Other columns are ignored.
    Without a kept vector the result is empty. Components beyond 2**27 raise. ``seen`` gets the number of vectors scanned in each pass."""
    if not 1 <= k <= 256:
        raise ValueError("k must be 1 to 256")
    kind = vectors.schema[id_col].dataType
    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("x"))
    packed = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("v", T.BinaryType())])
    blocks = stored(plain.mapInArrow(_pack("id", "x", dims, scale), packed), "kmeans-blocks")
    state = T.StructType([*packed, *[T.StructField(c, T.BinaryType()) for c in ("near", "upper", "lower")], T.StructField("totals", T.ArrayType(T.LongType()))])
    end = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    new = first_centroids(blocks, k, dims, salt)
    if not len(new):
        none = vectors.select(F.col(f"`{id_col}`"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        more = none.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
        return more.where(F.lit(False))
    old = radius = None
    for done in range(rounds + 1):
        after = blocks.mapInArrow(_round(dims, old, new, radius), state).persist(StorageLevel.DISK_ONLY)
        sums, counts, radius, scanned = _summed(after, len(new), dims)
        if seen is not None:
            seen.append(scanned)
        if done:
            blocks.unpersist()
        blocks, old = after, new
        if done < rounds:
            new = np.array([[s // n for s in own] if n else c.tolist() for own, n, c in zip(sums, counts, old)], np.int64)
    rows = stored(blocks.mapInArrow(_result(dims, new), end), "kmeans-rows")
    blocks.unpersist()
    of = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    names = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(new.tolist())}
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for j in of for x in (j, values[j])]), F.col("cluster"))
    return rows.select(
        F.col("id").alias(id_col), "cluster", "distance", pick({j: str(x) for j, x in of.items()}).cast("long").alias("cluster_inertia"),
        F.lit(str(sum(of.values()))).cast("long").alias("inertia"), pick(names).alias("centroid_sha256"),
    )
