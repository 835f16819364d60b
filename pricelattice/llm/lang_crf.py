"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and, if it is in the lexicon (frequent
words of the training sample), itself; all hashed into ``BUCKETS``. Each language has a weight per
bucket and each pair of languages a transition weight. Forward-backward gives every word its
distribution over languages in the context of its text, so that code-switched text gets labels
word by word (``label_words``); a text's language is the one with the greatest mean (``identify``).

Training sequences are runs of words of one labelled text, and joints of two runs of different
languages, so that transitions between languages are learnt as well. The gradient has the exact
word marginals and the exact marginals of neighbours, both by forward-backward.

Weights are learnt on the driver from a bounded sample of labelled documents; their number is
fixed by BUCKETS and the number of languages. Prediction runs where the texts are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, least_by_hash
from .pretokens import ragged

BUCKETS = 1 << 16
#: Labelled documents that train the weights, by least hash of the id.
SAMPLE = 2_000
LEXICON = 4_000
#: Words of a training sequence, sequences of a step, passes over the sample.
LENGTH, BATCH, EPOCHS = 32, 256, 2
#: Runs for each joint of two languages.
MIXED = 4
#: Distinct words that a Python worker remembers.
KEEP = 1_000_000
_WORD = regex.compile(r"\p{L}+")


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none for null."""
    return _WORD.findall(text.lower()) if text else []


def features(word: str, lexicon: frozenset) -> list[int]:
    """Buckets of a word's features."""
    bound = f"^{word}$"
    own = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)]
    if word in lexicon:
        own.append(f"w{word}")
    own += [bound[k : k + 3] for k in range(len(bound) - 2)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in own]


def _rows(words: list[str], lexicon: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other (no word is without), and where each word's begin."""
    own = [features(w, lexicon) for w in words]
    begin = np.cumsum([0, *map(len, own)])
    return np.array([b for o in own for b in o], np.int64), begin


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin[:-1], axis=0) if len(begin) > 1 else values[:0]


def forward_backward(emit: np.ndarray, counts: np.ndarray, move: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of sequences. ``emit`` (steps, sequences, labels) are positive potentials,
    ``counts`` the number of sequences that have each step (longest sequences first), ``move`` the
    positive transition potentials. Adds to ``pairs`` (labels, labels) the marginals of all
    neighbours."""
    steps = len(emit)
    ahead = np.empty_like(emit)
    for t in range(steps):
        n = counts[t]
        a = emit[t, :n] if t == 0 else (ahead[t - 1, :n] @ move) * emit[t, :n]
        ahead[t, :n] = a / a.sum(axis=1, keepdims=True)
    behind = np.ones(emit.shape[1:], emit.dtype)
    for t in range(steps - 1, -1, -1):
        n = counts[t]
        if t + 1 < steps and counts[t + 1]:
            m = counts[t + 1]
            after = emit[t + 1, :m] * behind[:m]
            b = after @ move.T
            if pairs is not None:
                weight = 1 / (ahead[t, :m] * b).sum(axis=1, keepdims=True)
                pairs += (ahead[t, :m] * weight).T @ after * move
            behind[:m] = b / b.sum(axis=1, keepdims=True)
        p = ahead[t, :n] * behind[:n]
        # the next step back reads ahead[t - 1] alone
        ahead[t, :n] = p / p.sum(axis=1, keepdims=True)
    return ahead


@dataclass
class Field:
    labels: list[str]
    lexicon: frozenset
    weights: np.ndarray  # (BUCKETS, labels)
    move: np.ndarray  # (labels, labels)

    def scores(self, words: list[str]) -> np.ndarray:
        flat, begin = _rows(words, self.lexicon)
        return _sums(self.weights[flat], begin)


def _sequences(docs: list[np.ndarray], langs: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, label of each word): every text in runs of LENGTH words, and as many joints of the ends of two runs of
    different languages as there are runs, divided by MIXED."""
    runs = [(d[s : s + LENGTH], lang) for d, lang in zip(docs, langs, strict=True) for s in range(0, len(d), LENGTH)]
    out = [(w, np.full(len(w), lang)) for w, lang in runs]
    for a, b in zip(rng.permutation(len(runs))[: len(runs) // MIXED], rng.permutation(len(runs))):
        (x, i), (y, j) = runs[a], runs[b]
        if i != j:
            x, y = x[: max(1, len(x) // 2)], y[-max(1, len(y) // 2) :]
            out.append((np.append(x, y), np.append(np.full(len(x), i), np.full(len(y), j))))
    return out


def gradient(words: list[np.ndarray], labels: list[np.ndarray], score: np.ndarray, move: np.ndarray):
    """Of the conditional likelihood of sequences (longest first), negated: by the score of each distinct word (rows of
    ``score``), and by the transition weights ``move``; the number of transitions."""
    size = score.shape[1]
    length = np.array([len(w) for w in words])
    there = np.arange(length[0])[:, None] < length[None, :]
    ids, label = np.zeros(there.shape, np.int64), np.zeros(there.shape, np.int64)
    for k, (w, y) in enumerate(zip(words, labels, strict=True)):
        ids[: len(w), k], label[: len(w), k] = w, y
    own = score[ids]
    emit = np.exp(np.clip(own - own.max(axis=2, keepdims=True), -30, 0))
    pairs = np.zeros((size, size))
    error = forward_backward(emit, there.sum(axis=1), np.exp(move), pairs)
    flat = error[there]
    flat[np.arange(len(flat)), label[there]] -= 1
    by_word = np.stack([np.bincount(ids[there], flat[:, c], len(score)) for c in range(size)], axis=1)
    both = there[1:]
    seen = np.zeros((size, size))
    np.add.at(seen, (label[:-1][both], label[1:][both]), 1)
    return by_word, pairs - seen, int(both.sum())


def train(texts: list[str], langs: list[str], seed: int = 3) -> Field:
    """Stochastic gradient (AdaGrad) on the conditional likelihood of the sequences of ``_sequences``."""
    labels = sorted(set(langs))
    docs = [letters(t) for t in texts]
    common = Counter(w for d in docs for w in d).most_common(LEXICON)
    lexicon = frozenset(w for w, n in common if n > 1)
    number = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    flat, begin = _rows(list(number), lexicon)
    size = len(labels)
    weights, move = np.zeros((BUCKETS, size)), np.zeros((size, size))
    sum_w, sum_m = np.full((BUCKETS, size), 1e-6), np.full((size, size), 1e-6)
    rng = np.random.default_rng(seed)
    rows = _sequences([np.array([number[w] for w in d], np.int64) for d in docs], np.array([labels.index(x) for x in langs], np.int64), rng)
    for _ in range(EPOCHS if size > 1 else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = sorted((rows[k] for k in order[lo : lo + BATCH]), key=lambda r: -len(r[0]))
            used, at = np.unique(np.concatenate([w for w, _ in own]), return_inverse=True)
            words = np.split(at, np.cumsum([len(w) for w, _ in own])[:-1])
            n = np.diff(begin)[used]
            buckets = flat[ragged(begin[used], n)]
            starts = np.append(0, np.cumsum(n))
            by_word, change, steps = gradient(words, [y for _, y in own], _sums(weights[buckets], starts), move)
            grad = np.stack([np.bincount(buckets, np.repeat(by_word[:, c], n), BUCKETS) for c in range(size)], axis=1)
            sum_w += grad**2
            weights -= 0.3 * grad / np.sqrt(sum_w)
            change = change / max(1, steps)
            sum_m += change**2
            move -= 0.1 * change / np.sqrt(sum_m)
            np.clip(move, -6, 6, out=move)
    return Field(labels, lexicon, weights.astype(np.float32), move.astype(np.float32))


class _Scores:
    """Potentials of words, remembered by each Python worker over all its tasks of one model."""

    def __init__(self, model: Field):
        self.model, self.number = model, {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)

    def of(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > KEEP:
            self.number = {}
        known = self.number
        new = list({w for d in docs for w in d if w not in known})
        need = len(known) + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table[: len(known)], np.zeros((need, self.table.shape[1]), np.float32)])
        for lo in range(0, len(new), 65_536):
            some = new[lo : lo + 65_536]
            s = self.model.scores(some)
            at = len(known)
            self.table[at : at + len(some)] = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -30, 0))
            for k, w in enumerate(some):
                known[w] = at + k
        return [np.array([known[w] for w in d], np.int64) for d in docs]


_MEMO: dict[int, _Scores] = {}


def marginals(model: Field, texts: list[str | None], scores: _Scores | None = None):
    """For each text with a letter its place and the distributions of its words over the languages."""
    scores = scores or _Scores(model)
    ids = scores.of([letters(t) for t in texts])
    move = np.exp(model.move)
    order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: -len(ids[k]))
    lo = 0
    while lo < len(order):
        steps = len(ids[order[lo]])
        own = order[lo : lo + max(1, min(1024, (1 << 19) // steps))]
        lo += len(own)
        length = np.array([len(ids[k]) for k in own])
        counts = (np.arange(steps)[:, None] < length[None, :]).sum(axis=1)
        emit = np.zeros((steps, len(own), len(model.labels)), np.float32)
        for c, k in enumerate(own):
            emit[: length[c], c] = scores.table[ids[k]]
        p = forward_backward(emit, counts, move)
        for c, k in enumerate(own):
            yield k, p[: length[c], c]


def predict(model: Field, texts: list[str | None], scores: _Scores | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: (`und`, 0) without a letter."""
    langs, best = ["und"] * len(texts), np.zeros(len(texts))
    for k, p in marginals(model, texts, scores):
        mean = p.mean(axis=0, dtype=np.float64)
        top = int(mean.argmax())
        langs[k], best[k] = model.labels[top], min(1.0, float(mean[top]))
    return langs, best


def spans(model: Field, texts: list[str | None], scores: _Scores | None = None) -> list[list[dict]]:
    """Of each text the runs of words (runs of letters) of one likeliest language: first word, number of words,
    language, mean probability."""
    out: list[list[dict]] = [[] for _ in texts]
    for k, p in marginals(model, texts, scores):
        top = p.argmax(axis=1)
        begin = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        n = np.diff(np.append(begin, len(top)))
        mean = np.add.reduceat(p[np.arange(len(top)), top].astype(np.float64), begin) / n
        out[k] = [
            {"first_word": a, "n_words": b, "lang": model.labels[c], "probability": min(1.0, m)}
            for a, b, c, m in zip(begin.tolist(), n.tolist(), top[begin].tolist(), mean.tolist(), strict=True)
        ]
    return out


def learnable(remainder: int = 2, modulus: int = 4) -> Column:
    """Whether the fold of a doc_id may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != remainder


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field learnt from ``docs(doc_id, text, lang)``: rows of the learning folds with a text
    and a language."""
    known = docs.where("lang is not null and text is not null").where(learnable()).select("doc_id").distinct()
    ids = least_by_hash(known, sample, ["doc_id"])
    told = docs.where("lang is not null and text is not null").join(ids, "doc_id").select("doc_id", "text", "lang")
    # a row an id, however often it repeats: that of the least hash
    rows = told.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("x")).select("doc_id", "x.*").toPandas()
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    return train(rows["text"].to_list(), rows["lang"].to_list())


def _applied(docs: DataFrame, id_col: str, text: str, lang: str, schema: str, none, of) -> DataFrame:
    """``of(model, texts, scores)`` of every row's text, as columns of ``schema``; ``none`` without a model."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    model = fit(plain)
    shared = spark.sparkContext.broadcast(model)
    key = zlib.crc32(model.weights.tobytes())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    @lean
    def run(batches):
        scores = _MEMO.get(key)
        if scores is None:
            _MEMO.clear()
            scores = _MEMO[key] = _Scores(shared.value)
        for batch in batches:
            texts = batch["text"].to_list()
            found = of(shared.value, texts, scores) if shared.value.labels else none(len(texts))
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: pd.Series(list(v), index=batch.index) for c, v in zip(names, found, strict=True)}})

    return plain.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {schema}").withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``lang_pred``, ``score``.

    A null text, or one without a letter, is `und` with score 0, and so is every text if there is
    nothing to learn from. Repeated rows get equal results. An empty table gives an empty result. Other
    columns are ignored."""
    none = lambda n: (["und"] * n, np.zeros(n))
    return _applied(docs, id_col, text, lang, "lang_pred string, score double", none, predict)


def label_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``spans``, the runs of words of one language in a text, with the
    probability of that language. No spans for a null text, one without a letter, or if there is nothing to learn
    from; else as ``identify``."""
    schema = "spans array<struct<first_word:int,n_words:int,lang:string,probability:double>>"
    return _applied(docs, id_col, text, lang, schema, lambda n: ([[]] * n,), lambda *x: (spans(*x),))
