"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, over all documents.
2. A randomised singular value decomposition of the TF-IDF matrix of all passages (``WINDOW``
   words, every ``STRIDE``): tasks add up their share of A'(A Omega) for a random Omega, and the
   Nystroem formula gives the leading right singular vectors from that one sum of fixed size.
3. Every passage of every document is projected, whitened and compared by cosine with the passages
   of the benchmark. What comes near is verified: a bound from shared words, then the longest
   common subsequence of the item's words with the words around the passage. A paraphrase, which
   has less than ``NEARLY`` of the item in order, must also hold the item's answer (its last
   sentence) in the same way.
4. What the cosine leaves out is found by count, without loss. Of an item of n words, needed(n) must
   be there, so n - needed(n) may be missing, and of its n - needed(n) + k rarest words k must stand
   around a passage. Where they do, the place is verified like any other. Items of under ``SHORT``
   words, which need an exact run, are looked up by hashes of runs of words.

Words are lower-cased; ASCII white space and punctuation stand between them. The benchmark goes through in blocks of
``ITEMS`` items, so that what is sent to all tasks is bounded.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, lean
from .word_hash import plain_words, runs, word_hashes

HASHED = 1 << 14
SKETCH = 64
#: Leading singular directions left out: they tell languages and frequent words apart, not passages.
SKIP = 8
STRIDE = 12
WINDOW = 2 * STRIDE
ITEMS = 5_000
#: Items of fewer words match as an exact run only.
SHORT = 8
#: Least cosine of a candidate passage.
COSINE = 0.5
#: Least share of a candidate's words, by inverse document frequency, that the item has.
SHARED = 0.35
NEARLY = 0.8
def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words of ``texts``, and the number of words of each."""
    hashes, n = word_hashes(texts)
    return _feature(hashes), n


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(HASHED)).astype(np.int64)


def _runs(texts):
    for rows, hashes, n in runs(texts):
        yield rows, _feature(hashes), n


def _block_sums(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each block the sum of its words' rows of ``table``, one place of all blocks at a time."""
    n = np.diff(np.append(starts, len(ids)))
    padded = np.append(ids, np.zeros(STRIDE, np.int64))
    out = table.take(ids[starts], axis=0)
    rows = np.empty_like(out)
    for place in range(1, STRIDE):
        np.take(table, padded[starts + place], axis=0, out=rows, mode="clip")
        rows[n <= place] = 0
        out += rows
    return out


def _add_by_word(total: np.ndarray, ids: np.ndarray, g: np.ndarray, block: np.ndarray) -> None:
    """Add ``g[block]`` of each word to its row of ``total``: the first word of every kind, the second
    of every kind, and so on; words of over ``SKETCH`` places on their own."""
    at = block[np.argsort(ids.astype(np.uint16), kind="stable")]
    n = np.bincount(ids, minlength=HASHED)
    first, by = np.cumsum(n) - n, np.argsort(-n, kind="stable")
    by = by[: np.count_nonzero(n)]
    n, first = n[by], first[by]
    acc = g[at[first]]
    for place in range(1, SKETCH):
        more = np.searchsorted(-n, -place)
        acc[:more] += g[at[first[:more] + place]]
    for k in range(np.searchsorted(-n, -SKETCH)):
        acc[k] += g[at[first[k] + SKETCH : first[k] + n[k]]].sum(axis=0)
    total[by] += acc


def _blocks(lengths: np.ndarray):
    """Starts of the blocks of STRIDE words, the document of each, and for each block the next one
    of the same document (or itself): a block and its next are a window."""
    n = -(-lengths // STRIDE)
    doc = np.repeat(np.arange(len(lengths)), n)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(lengths) - lengths, n)
    more = inside + 1 < np.repeat(n, n)
    return first + inside * STRIDE, doc, inside, np.arange(len(doc)) + more


def _windows(per_word: np.ndarray, starts: np.ndarray, follow: np.ndarray) -> np.ndarray:
    return _pairs(np.add.reduceat(per_word, starts, axis=0), follow)


def _pairs(blocks: np.ndarray, follow: np.ndarray) -> np.ndarray:
    twice = follow != np.arange(len(follow))
    return blocks + blocks[follow] * (twice[:, None] if blocks.ndim > 1 else twice)


@lean
def _document_frequencies(batches):
    counts, docs = np.zeros(HASHED, np.int64), 0
    for batch in batches:
        docs += len(batch)
        for _, ids, lengths in _runs(batch["text"].to_list()):
            doc = np.repeat(np.arange(len(lengths)), lengths)
            counts += np.bincount(np.unique(doc * HASHED + ids) % HASHED, minlength=HASHED)
    used = np.flatnonzero(counts)
    yield pd.DataFrame({"f": np.append(used, -1), "n": np.append(counts[used], docs)})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)), over all rows of ``docs(text)``."""
    found = docs.mapInPandas(_document_frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(HASHED)
    real = found["f"] >= 0
    df[found.loc[real, "f"].to_numpy()] = found.loc[real, "n"]
    return np.log((1 + found.loc[~real, "n"].sum()) / (1 + df)).astype(np.float32)


def _sketch(idf: np.ndarray):
    @lean
    def run(batches):
        weighted = np.random.default_rng(11).normal(size=(HASHED, SKETCH)).astype(np.float32) * idf[:, None]
        total = np.zeros((HASHED, SKETCH))
        for batch in batches:
            for _, ids, lengths in _runs(batch["text"].to_list()):
                starts, _, _, follow = _blocks(lengths)
                norm2 = _windows(idf[ids] ** 2, starts, follow)
                y = _pairs(_block_sums(weighted, ids, starts), follow) / np.maximum(norm2, 1e-9)[:, None]
                g = y.copy()  # a block's words stand in its own window and in the one before
                twice = np.flatnonzero(follow != np.arange(len(follow)))
                g[follow[twice]] += y[twice]
                _add_by_word(total, ids, g, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids)))))
        total *= idf[:, None]
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"f": used, **{f"y{k}": total[used, k].astype(np.float32) for k in range(SKETCH)}})

    return run


def projection(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """A row for each of HASHED: a word's whitened coordinates in the right singular space (ranks
    SKIP to SKETCH) of the TF-IDF passages of ``docs(text)``."""
    cols = [f"y{k}" for k in range(SKETCH)]
    schema = T.StructType([T.StructField("f", T.LongType()), *[T.StructField(c, T.FloatType()) for c in cols]])
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # each returns HASHED rows, however many texts it reads
    parts = (
        docs.where("text is not null")
        .coalesce(tasks)
        .mapInPandas(_sketch(idf), schema)
        .groupBy("f")
        .agg(*[F.sum(c).alias(c) for c in cols])
        .toPandas()  # HASHED rows at most
    )
    y = np.zeros((HASHED, SKETCH))
    y[parts["f"].to_numpy(np.int64)] = parts[cols].to_numpy()
    omega = np.random.default_rng(11).normal(size=(HASHED, SKETCH)).astype(np.float32)
    core = omega.T @ y
    lam, vec = np.linalg.eigh((core + core.T) / 2)
    good = lam > max(lam.max(), 1e-12) * 1e-6
    half = y @ (vec[:, good] / np.sqrt(lam[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    r = int((s > s[:1].max(initial=0) * 1e-4).sum())
    some = slice(min(SKIP, r), r)  # none in a corpus of few directions: its matches come by the counts of rare words
    return (u[:, some] / np.maximum(s[some], 1e-12) * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := places.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def needed(n: int) -> int:
    """Words of an item of ``n`` words that must be found in order."""
    return math.ceil(0.6 * n) if n >= 20 else math.ceil(0.75 * n) if n >= 8 else n


def answer_of(text: str) -> list[str]:
    """The words of an item's last sentence or line."""
    parts = [p for p in (plain_words(x) for x in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n", text or "")) if p]
    return parts[-1] if parts else []


class _Item:
    def __init__(self, item_id, text: str, times: int = 1):
        self.id, self.text, self.words, self.answer = item_id, text, plain_words(text), answer_of(text)
        self.times = times


def verified(item: _Item, around: list[str]) -> tuple[int, bool] | None:
    """(words of the item found in order, whether the answer is there), or None for no match."""
    n = len(item.words)
    if n < SHORT:  # too short for gaps: an exact run only
        hit = any(around[k : k + n] == item.words for k in range(len(around) - n + 1))
        return (n, True) if hit else None
    length = lcs(item.words, around)
    if length < needed(n):
        return None
    answered = 2 * lcs(item.answer, around) >= len(item.answer)
    return (length, answered) if answered or length >= NEARLY * n else None


class _ByCount:
    """Places in texts that can hold an item by the number of its rare words, or an exact short item."""

    def __init__(self, items: list[_Item], idf: np.ndarray):
        n = np.array([len(item.words) for item in items])
        self.least, self.span = np.zeros(len(items), np.int64), 2 * n + WINDOW
        words, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        short: dict[int, dict[int, list[int]]] = {}
        for k, item in enumerate(items):
            hashes = word_hashes([item.text])[0]
            if n[k] < SHORT:
                short.setdefault(int(n[k]), {}).setdefault(int(self._grams(hashes, n[k])[0]), []).append(k)
                continue
            one, times = np.unique(hashes, return_counts=True)
            rarest = np.argsort(-idf[_feature(one)], kind="stable")
            mass, spare = np.cumsum(times[rarest]), n[k] - needed(n[k])
            some = np.searchsorted(mass, spare + needed(n[k]) // 3) + 1
            self.least[k] = mass[some - 1] - spare
            words.append(one[rarest[:some]])
            own.append(np.full(some, k))
        flat, own = np.concatenate(words), np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        self.words, first = np.unique(flat[order], return_index=True)
        self.own, self.edges = own[order], np.append(first, len(flat))
        self.some = np.zeros(1 << 18, bool)
        self.some[self._slot(self.words)] = True
        self.short = {m: (np.array(sorted(g), np.uint64), g) for m, g in short.items()}

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 18) - 1)).astype(np.int64)

    @staticmethod
    def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
        return out

    def places(self, hashes: np.ndarray, lengths: np.ndarray):
        """(text, item, starts of passages) of all that can match."""
        first = np.cumsum(lengths) - lengths
        doc_of = np.repeat(np.arange(len(lengths)), lengths)
        for n, (grams, items) in self.short.items():
            found = self._grams(hashes, n)
            at = np.flatnonzero(np.isin(found, grams))
            at = at[doc_of[at] == doc_of[at + n - 1]]
            seen: dict[tuple[int, int], list[int]] = {}
            for p in at:
                for k in items[int(found[p])]:
                    seen.setdefault((int(doc_of[p]), k), []).append(int(p - first[doc_of[p]]) // STRIDE * STRIDE)
            yield from ((doc, k, starts) for (doc, k), starts in seen.items())
        if not len(self.words):
            return
        pos = np.flatnonzero(self.some[self._slot(hashes)])
        word = np.minimum(np.searchsorted(self.words, hashes[pos]), len(self.words) - 1)
        real = self.words[word] == hashes[pos]
        pos, word = pos[real], word[real]
        times = self.edges[word + 1] - self.edges[word]
        item = self.own[np.repeat(self.edges[word] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        pos = np.repeat(pos, times)
        order = np.argsort(item.astype(np.uint16 if len(self.least) <= 1 << 16 else np.int64), kind="stable")
        item, pos = item[order], pos[order]
        last = np.arange(len(pos)) + self.least[item] - 1
        j = np.flatnonzero(last < len(pos))
        last = last[j]
        near = (item[last] == item[j]) & (doc_of[pos[last]] == doc_of[pos[j]]) & (pos[last] - pos[j] < self.span[item[j]])
        j, last = j[near], last[near]
        if not len(j):
            return
        doc, item = doc_of[pos[j]], item[j]
        n = (self.span[item] - WINDOW) // 2
        low = np.maximum(0, (pos[last] - first[doc] - WINDOW - n) // STRIDE + 1)
        high = np.minimum((pos[j] - first[doc] + n) // STRIDE, (lengths[doc] - 1) // STRIDE)
        edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        for a, b in zip(edge, np.append(edge[1:], len(j)), strict=True):
            blocks = sorted({x for lo, hi in set(zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)) for x in range(lo, hi + 1)})
            yield int(doc[a]), int(item[a]), [x * STRIDE for x in blocks]


def _search(shared):
    @lean
    def run(batches):
        project, idf, items = shared.value
        by_count = _ByCount(items, idf)
        own, vectors, ids_of = [], [], []
        has, mark = np.zeros((len(items), HASHED), bool), np.zeros(HASHED, bool)
        for k, item in enumerate(items):
            ids = features([item.text])[0]
            has[k, ids] = True
            ids_of.append(ids)
            n = len(ids)
            for s in range(0, max(1, n - WINDOW + STRIDE), STRIDE):
                s = max(0, min(s, n - WINDOW))
                vectors.append(project[ids[s : s + WINDOW]].sum(axis=0))
                own.append(k)
        target, own = _unit(np.array(vectors)).T.copy(), np.array(own)
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            texts = batch["text"].to_list()
            for rows, hashes, lengths in runs(texts):
                ids = _feature(hashes)
                starts, doc, inside, follow = _blocks(lengths)
                spaced = _unit(_pairs(_block_sums(project, ids, starts), follow))
                first = np.cumsum(lengths) - lengths
                end = np.minimum(starts + WINDOW, (first + lengths)[doc])
                padded = np.append(ids, np.zeros(WINDOW, np.int64))
                # a last block is part of the window before it, unless it is the only one
                whole = np.flatnonzero((follow != np.arange(len(follow))) | (inside == 0))
                for lo in range(0, len(whole), 4096):
                    near = spaced[whole[lo : lo + 4096]] @ target
                    win, passage = np.nonzero(near >= COSINE)
                    cosine, item, win = near[win, passage], own[passage], whole[win + lo]
                    at_word = starts[win, None] + np.arange(WINDOW)
                    weight = idf[padded[at_word]] * (at_word < end[win, None])
                    held = (weight * has[item[:, None], padded[at_word]]).sum(axis=1)
                    for j in np.flatnonzero(held >= SHARED * weight.sum(axis=1)):
                        row, it, at = int(rows[doc[win[j]]]), int(item[j]), int(inside[win[j]]) * STRIDE
                        seen = best.get((row, it))
                        if seen and seen[0] <= at <= seen[1]:
                            continue  # verified with the same surroundings
                        n = len(items[it].words)
                        a, b = max(0, at - n), at + WINDOW + n
                        lo_word = first[doc[win[j]]]
                        region = ids[lo_word + a : min(lo_word + b, lo_word + lengths[doc[win[j]]])]
                        mark[region] = True
                        bound = mark[ids_of[it]].sum()
                        mark[region] = False
                        if bound < needed(n):
                            continue  # a bound on the common subsequence
                        if (row, -1) not in best:
                            best[row, -1] = plain_words(texts[row])
                        words_of = best[row, -1]
                        got = verified(items[it], words_of[a:b])
                        if got and (not seen or got[0] > seen[2]):
                            best[row, it] = (at, at + n, got[0], got[1], float(cosine[j]))
                block_of = np.cumsum(-(-lengths // STRIDE)) + lengths // -STRIDE
                for d, it, places in by_count.places(hashes, lengths):
                    row, n = int(rows[d]), len(items[it].words)
                    for at in places:
                        seen = best.get((row, it))
                        if seen and seen[2] == n:
                            break  # found whole
                        a, b = max(0, at - n), at + WINDOW + n
                        region = ids[first[d] + a : first[d] + min(b, lengths[d])]
                        mark[region] = True
                        bound = mark[ids_of[it]].sum()
                        mark[region] = False
                        if bound < needed(n) or (seen and bound <= seen[2]):
                            continue
                        if (row, -1) not in best:
                            best[row, -1] = plain_words(texts[row])
                        got = verified(items[it], best[row, -1][a:b])
                        if got and (not seen or got[0] > seen[2]):
                            window = block_of[d] + at // STRIDE
                            window -= inside[window] > 0 and follow[window] == window
                            near = (spaced[window] @ target[:, own == it]).max()
                            best[row, it] = (at, at + n, got[0], got[1], float(near))
                for key in [k for k in best if k[1] < 0]:
                    del best[key]
            keys = list(best)
            yield pd.DataFrame(
                {
                    "id": batch["id"].iloc[[k[0] for k in keys]].to_numpy(),
                    "item_id": pd.Series([items[k[1]].id for k in keys], dtype=object),
                    "n_item_words": [len(items[k[1]].words) for k in keys],
                    "n_common": [best[k][2] for k in keys],
                    "answer_found": [best[k][3] for k in keys],
                    "cosine": [best[k][4] for k in keys],
                    "word_start": [best[k][0] for k in keys],
                    "times": [items[k[1]].times for k in keys],
                }
            )

    return run


RESULT = "id {}, item_id {}, n_item_words long, n_common long, answer_found boolean, cosine double, word_start long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document row and benchmark item found in it: the id, ``item_id``,
    ``n_item_words``, ``n_common`` (words found in order), ``answer_found``, ``cosine`` and
    ``word_start`` (place of the passage in words).

    Null, empty and blank texts of either table match nothing. A repeated document row gives its
    rows again; a repeated item is searched once and found as often as it stands in the benchmark. Ids
    of both tables may have any type. Rows with a null id are searched too and return a null id. An empty table of either kind gives an empty result.
    Other columns are ignored."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    texts = plain.select("text")
    items = benchmark.where("text is not null and item_id is not null").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    result = RESULT.format(plain.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    blocks = max(1, math.ceil(items.count() / ITEMS))
    project = idf = found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toPandas()
        own = [x for x in (_Item(*x) for x in rows.itertuples(index=False, name=None)) if x.words]
        if not own:
            continue
        if project is None:
            idf = inverse_frequencies(texts)
            project = projection(texts, idf)
        shared = spark.sparkContext.broadcast((project, idf, own))
        part = plain.where("text is not null").mapInPandas(_search(shared), f"{result}, times long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"{result}, times long")
    found = found.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    return found.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose id ``contaminated`` finds; rows with a null id stay unless a
    row with a null id is found."""
    found = free(docs, "__id")
    ids = contaminated(docs.select(id_col, text), benchmark, id_col, text).select(F.col(id_col).alias(found)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col(found)), "left_anti")
