"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

1. Every word gets a sparse random index vector (a few +1 and -1 among ``DIM`` places) from its
   hash; words share ``BUCKETS`` hash buckets. A word's vector is the sum of the index vectors of
   the words up to ``REACH`` places around it, over all documents. Each task adds up its own
   table; tables meet in a sum by bucket. The finished table has BUCKETS x DIM numbers (4 MB) at
   any size of corpus, so it is sent to all tasks.
2. A document is pooled from its words' vectors, scaled to length one: their mean, their spread,
   the mean product of neighbours' index vectors (repetition shows there), the log of its words.
3. A two-layer network is trained on the driver with a bounded sample of labelled documents and its
   logits are divided by a temperature fitted on a held-back part of that sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, give_back, lean, least_by_hash
from .pretokens import steps
from .word_hash import exact_hashes


BUCKETS = 1 << 15
DIM = 32
NONZERO = 4
REACH = 2
#: Labelled documents that train the network, by least hash of the id.
SAMPLE = 20_000
HIDDEN = 32
#: Word occurrences that one step handles at once, which bounds a task's memory: of contexts, and of pooling.
STEP, POOL_STEP = 1 << 18, 1 << 16
FEATURES = 3 * DIM + 1


@lru_cache(1)
def index_vectors() -> np.ndarray:
    """BUCKETS x DIM: the fixed random index vector of each bucket."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def _some(texts: pa.Array):
    """Lists of the texts of one batch, of a few megabytes each; a null counts as empty."""
    texts = pc.fill_null(texts, "")
    for lo, hi in steps(texts):
        yield texts.slice(lo, hi - lo).to_pylist()


def _flat(texts, step: int):
    """Runs of whole documents of about ``step`` words: (bucket of each word, words per document)."""
    runs, held, own, size = [], 0, [], 0
    for k, text in enumerate(texts):
        own.append(text or "")
        size += len(own[-1])
        last = k + 1 == len(texts)
        if size >= 6 * POOL_STEP or last:  # so many words are hashed at once, taken as six characters each
            hashes, n = exact_hashes(own)
            runs.append(((hashes % np.uint64(BUCKETS)).astype(np.int64), n.astype(np.int64)))
            held += len(hashes)
            own, size = [], 0
        if runs and (held >= step or last):
            yield tuple(np.concatenate(x) for x in zip(*runs))
            runs, held = [], 0


@lean
def _context_tables(batches):
    table = np.zeros(BUCKETS * DIM)
    index = index_vectors()
    where = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(index, where, axis=1)
    for batch in batches:
        for texts in _some(batch.column(0)):
            for ids, lengths in _flat(texts, STEP):
                doc = np.repeat(np.arange(len(lengths)), lengths)
                for gap in range(1, REACH + 1):
                    same = doc[gap:] == doc[:-gap]
                    left, right = ids[:-gap][same], ids[gap:][same]
                    for word, other in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            table += np.bincount(word * DIM + where[other, k], sign[other, k], BUCKETS * DIM)
    table = table.reshape(BUCKETS, DIM)
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    yield pa.RecordBatch.from_pydict({"bucket": used, **{f"v{k}": table[used, k] for k in range(DIM)}})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM vectors of length one (zero for a bucket without context)."""
    cols = [f"v{k}" for k in range(DIM)]
    schema = T.StructType([T.StructField("bucket", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in cols]])
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # each returns BUCKETS rows, however many texts it reads
    sums = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(text).alias("text"))
        .coalesce(tasks)
        .mapInArrow(_context_tables, schema)
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in cols])
        .toPandas()  # BUCKETS rows at most
    )
    out = np.zeros((BUCKETS, DIM))
    out[sums["bucket"].to_numpy(np.int64)] = sums[cols].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pool(texts, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    parts = []
    for ids, lengths in _flat(texts, POOL_STEP):
        out = np.zeros((len(lengths), FEATURES), np.float32)
        full = lengths > 0
        if len(ids):
            starts = (np.cumsum(lengths) - lengths)[full]
            n = lengths[full, None].astype(np.float32)
            v = vectors[ids]
            mean = np.add.reduceat(v, starts, axis=0) / n
            out[full, :DIM] = mean
            out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / n - mean**2, 0))
            near = index[ids]
            near[:-1] *= near[1:]
            near[np.append(starts[1:], len(ids)) - 1] = 0
            out[full, 2 * DIM : 3 * DIM] = np.add.reduceat(near, starts, axis=0) / n
            out[full, -1] = np.log1p(lengths[full]) / 10
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


@dataclass
class Network:
    """Two layers on standardised features; ``score`` is the calibrated probability of label 1."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.center) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on cross-entropy; a tenth of the rows fits the temperature. Without rows of both labels
    the score is the share of label 1 (0.5 without rows)."""
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden))
    params = [w1, np.zeros(hidden), np.zeros(hidden), np.array(np.log(share / (1 - share)))]
    net = Network(center, scale, *params)
    if len(set(y.tolist())) < 2:
        return net
    order = rng.permutation(len(y))
    held, rest = order[: len(y) // 10], order[len(y) // 10 :]
    params[2] += rng.normal(0, 0.1, hidden)
    z = (x - center) / scale
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    size = 128
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for part in np.array_split(rng.permutation(rest), max(1, len(rest) // size)):
            zb, yb = z[part], y[part]
            h = np.tanh(zb @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - yb) / len(part)
            gh = g[:, None] * params[2] * (1 - h * h)
            grads = [zb.T @ gh + 1e-5 * params[0], gh.sum(axis=0), h.T @ g + 1e-5 * params[2], np.array(g.sum())]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, scale, params[0], params[1], params[2], float(params[3]))
    if len(held):
        logit = net.logits(x[held])

        def loss(temperature):
            s = logit / temperature
            return np.mean(np.logaddexp(0, s) - y[held] * s)

        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _scorer(shared, features: bool):
    """The function of a column of texts to their features or scores. Only the texts go to Python and only numbers come back."""

    @F.arrow_udf(T.ArrayType(T.FloatType()) if features else T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        vectors, net = shared.value
        index, out = index_vectors(), []
        for some in _some(texts):
            x = _pool(some, vectors, index)
            if features:
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel())))
            else:
                out.append(pa.array(net.score(x).astype(float)))
        give_back()
        return pa.concat_arrays([pa.array([], pa.list_(pa.float32()) if features else pa.float64()), *out])

    return run


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, text: str = "text"):
    """Broadcast (word vectors, network). ``labels(doc_id, quality)``; rows with a null are
    ignored. ``allowed`` says of a doc_id whether its label may be learnt from."""
    spark: SparkSession = docs.sparkSession
    give_back()  # what stages before have left on the driver
    vectors = word_vectors(docs, text)
    give_back()
    shared = spark.sparkContext.broadcast((vectors, None))
    known = (
        labels.where("doc_id is not null and quality is not null")
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    told = docs.select("doc_id", F.col(text).alias("text")).join(least_by_hash(known, sample, ["doc_id"]), "doc_id")
    one = told.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row an id, however often it repeats
    rows = one.select("doc_id", "quality", _scorer(shared, True)("text").alias("__features")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack(rows["__features"].to_list()) if len(rows) else np.zeros((0, FEATURES), np.float32)
    y = rows["quality"].to_numpy(np.float64)
    del rows
    give_back()
    net = train(x.astype(np.float64), y)
    shared.unpersist()
    del x
    give_back()
    return spark.sparkContext.broadcast((vectors, net))


def learnable(remainder: int = 1, modulus: int = 3) -> Column:
    """Whether the fold of a doc_id may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != remainder


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``score``, the probability that ``labels.quality``
    is 1, learnt from the rows of ``labels`` outside the held-out fold.

    Null, empty and blank texts have all-zero features and get the network's score for these. Repeated
    rows get equal scores. Without usable labels every score is 0.5. An empty table gives an empty
    result. Other columns are ignored."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    shared = fit(plain, labels.select("doc_id", "quality"), learnable())
    return plain.select(F.col("doc_id").alias(id_col), _scorer(shared, False)("text").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id``) whose score is at least ``least``, with all columns."""
    shared = fit(docs.select("doc_id", F.col(text).alias("text")), labels.select("doc_id", "quality"), learnable())
    score = free(docs, "__score")
    scored = docs.withColumn(score, _scorer(shared, False)(F.col(f"`{text}`")))
    return scored.where(F.col(score) >= least).select(*docs.columns)
