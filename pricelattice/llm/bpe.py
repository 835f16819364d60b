"""Byte-level BPE in DataFrame operations.

Encoding: a text splits into pretokens by the pattern of the vocabulary. Pretokens that are not
tokens themselves are folded by higher-order functions: the fold starts from the bytes of a pretoken
and merges the adjacent pair of least rank until no pair has a rank. The pretokens are counted over
all texts and the most frequent (``HOT`` at most) are folded once; the others are folded once in
each text that holds them. Arrow functions on both sides of the fold split the texts and put the ids
in place: they cut many texts at once into pieces at sure ends of pretokens, and apply the pattern to
distinct pieces alone.

The rank map is constant: one row of arrays that stands in the plan as an uncorrelated scalar
subquery, so it acts as a literal without being printed as one. It maps two ids to the id of their
merge. Row displacement makes it flat: the pair (l, r) is in cell ``shift[l] + r``, which names its
l, so a look-up is two array reads.

Decoding: ids to byte pieces, concatenated.

A pretoken of over ``LONG`` bytes is merged by the same rule with a heap: the fold is quadratic in
its length.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored
from .pretokens import BYTE_LEVEL, cuts, pieces, ragged, steps

#: Folded pretokens that every task holds.
HOT = 1 << 19
#: Bytes of a pretoken beyond which it is merged with a heap.
LONG = 256
#: Pretokens or ids that a step in Python handles at once, which bounds its memory.
STEP = 1 << 18
_IDS = T.ArrayType(T.IntegerType())
#: A part in the fold: its id below the bit ``_AT``, its first byte (LONG at most) from there on, from bit 32 the rank, ``_NONE`` if no pair has one.
_AT, _ID, _NONE = 23, (1 << 23) - 1, 1 << 23


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a .tiktoken file (lines: base64 of the token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def finder(pattern: str):
    r"""The function from a text to its pretokens. ``\s`` and ``\S`` are spelt as Unicode white space."""
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken of any length, with a heap of pairs over a linked list."""
    if word in ranks:
        return [ranks[word]]
    end, parts = len(word), [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < end and (r := ranks.get(t := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (r, i, t))

    for i in range(end):
        push(i)
    while heap:
        _, i, t = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= end or len(parts[i]) + len(parts[j]) != len(t) or parts[i] + parts[j] != t:
            continue  # one of the two has changed since
        parts[i], parts[j], after[i] = t, b"", after[j]
        if after[j] < end:
            before[after[j]] = i
        push(i)
        push(before[i])
    return [ranks[p] for p in parts if p]


def merges(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (id, id, id of both joined) for every split of a token into two tokens."""
    found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(found, np.int64).reshape(-1, 3)


def displaced(pairs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift per left id, cells): cell ``shift[l] + r`` holds ``l << 32 | merged``, or -1."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    lefts, begin, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    span = 1 << max(4, int(4 * len(pairs)).bit_length())
    cells, shift = np.full(span + size, -1, np.int64), np.zeros(size, np.int32)
    rng = np.random.default_rng(3)
    for k in np.argsort(-n, kind="stable"):  # full rows first, while the cells are empty
        own = pairs[begin[k] : begin[k] + n[k]]
        while True:
            tries = rng.integers(0, span, 64)
            fits = (cells[tries[:, None] + own[:, 1]] < 0).all(axis=1)
            if fits.any():
                break
        shift[lefts[k]] = at = tries[fits.argmax()]
        cells[at + own[:, 1]] = lefts[k] << 32 | own[:, 2]
    return shift, cells


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Fold:
    """The ranked merges of one rank file, as an expression."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        single = [ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("every byte needs a rank")
        shift, cells = displaced(merges(ranks), max(ranks.values()) + 1)
        row = pa.table({
            "single": pa.array([single], pa.list_(pa.int32())),
            "shift": pa.array([shift], pa.list_(pa.int32())),
            "cells": pa.array([cells], pa.list_(pa.int64())),
        })
        self._row = spark.createDataFrame(row).select(F.struct("single", "shift", "cells").alias("tables"))

    def add(self, df: DataFrame, pretokens: str, out: str) -> DataFrame:
        """Add ``out``: ids of each of the array ``pretokens`` (strings)."""
        # the optimizer puts the subquery, which analysis wants in a column, in the place of its one use
        known = df.select("*", self._row.scalar().alias("__bpe_tables"))
        both = F.struct(F.col("__bpe_tables").alias("t"), F.col(pretokens).alias("own"))
        ids = _let(both, lambda x: F.transform(x["own"], lambda w: self._word(x["t"], w)))
        return known.select(*[F.col(f"`{c}`") for c in df.columns], ids.alias(out))

    def _word(self, t: Column, word: Column) -> Column:
        """The fold over an array of longs, one for each part: rank of its merge with the next one (``_NONE`` if there is none), its first byte,
        its id. The least of them is the leftmost pair of least rank."""
        none = F.array().cast("array<bigint>")
        own_id = lambda part: part.bitwiseAND(F.lit(_ID)).cast("int")

        def rank(left, right):
            cell = F.get(t["cells"], F.get(t["shift"], left) + right)
            merged = F.when(F.shiftright(cell, 32) == left, cell.bitwiseAND(F.lit(0xFFFFFFFF)))
            return F.shiftleft(F.coalesce(merged, F.lit(_NONE)), 32)

        letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # a character for each byte
        start = _let(
            F.transform(letters, lambda b: F.get(t["single"], F.ascii(b))),
            lambda p: F.transform(p, lambda own, i: rank(own, F.get(p, i + 1)) + F.shiftleft(i.cast("bigint"), _AT) + own),
        )

        def merge(v, _):
            def at(least, i):  # i: place (from 1) of the least
                new, place = F.shiftrightunsigned(least, 32).cast("int"), least.bitwiseAND(F.lit(0xFFFFFFFF ^ _ID))
                before, after = F.get(v, i - 2), F.get(v, i + 1)
                joined = rank(new, own_id(after)) + place + new
                left = rank(own_id(before), new) + before.bitwiseAND(F.lit(0xFFFFFFFF))
                changed = F.when(i > 1, F.array(left, joined)).otherwise(F.array(joined))
                return F.concat(F.slice(v, F.lit(1), F.greatest(i - 2, F.lit(0))), changed, F.slice(v, i + 2, F.size(v)))

            place = lambda least: _let(F.array_position(v, least).cast("int"), lambda i: at(least, i))
            return _let(F.array_min(v), lambda least: F.when(least >= _NONE << 32, v).otherwise(place(least)))

        folded = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), F.coalesce(start, none), merge)
        return F.transform(folded, own_id)


def _lists(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values and offsets (from 0) of a list array without nulls."""
    if not len(x):  # its offsets may be missing
        return x.values.slice(0, 0), np.zeros(1, np.int64)
    offsets = x.offsets.to_numpy()
    return x.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets.astype(np.int64) - offsets[0]


class Known:
    """Pretokens whose ids are known: the tokens themselves and the hot pretokens. The last of them
    (from ``whole`` on) are tokens that the pattern would part if they stood alone."""

    def __init__(self, ranks: dict[bytes, int], hot: pa.Table, find):
        own = {}
        for t, r in ranks.items():
            try:
                own[t.decode()] = r
            except UnicodeDecodeError:
                pass
        parted = [t for t in own if find(t) != [t]]
        plain = [t for t in own if t not in set(parted)]
        hot = hot.combine_chunks()
        words, ids = hot["word"].combine_chunks(), hot["ids"].combine_chunks()
        flat, offsets = _lists(ids)
        rank = lambda some: np.array([own[t] for t in some], np.int32)
        self.words = pa.concat_arrays([pa.array(plain, pa.string()), words.cast(pa.string()), pa.array(parted, pa.string())])
        self.whole = len(plain) + len(words)
        self.ids = np.concatenate([rank(plain), flat.to_numpy(zero_copy_only=False).astype(np.int32), rank(parted)])
        self.length = np.concatenate([np.ones(len(plain), np.int64), np.diff(offsets), np.ones(len(parted), np.int64)])
        self.start = np.cumsum(self.length) - self.length

    def number(self, words: pa.Array) -> np.ndarray:
        """Place of each of the distinct ``words`` here (the first one), or -1. The known words are looked up among the given
        ones: a hash table of all known ones would take 50 MB for each call."""
        found = pc.index_in(self.words, value_set=words)
        place = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))[::-1]  # of equal ones the first is written last
        out = np.full(len(words), -1, np.int64)
        out[found.drop_null().to_numpy()[::-1]] = place
        return out


def _slices(offsets: np.ndarray):
    """Ranges of whole texts with about STEP values together."""
    lo = 0
    while lo + 1 < len(offsets):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP, side="right")) - 1)
        yield lo, hi
        lo = hi


def _list_array(offsets: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _pretokens(unique: pa.Array, find) -> tuple[list[str], np.ndarray]:
    """Pretokens of pieces one after the other, and how many each has."""
    found = [find(p) for p in unique.cast(pa.string()).to_pylist()]
    return [w for own in found for w in own], np.array([len(own) for own in found], np.int64)


def _split(words: np.ndarray, offsets: np.ndarray, unknown_words: pa.Array, known: Known, ranks: dict[bytes, int]) -> pa.Array:
    """``words``: the known number of each pretoken, or that of an unknown one after them; ``offsets``:
    where texts begin."""
    size, ids = pc.binary_length(unknown_words).to_numpy(), known.ids
    length, start = np.append(known.length, np.zeros(len(size), np.int64))[words], np.append(known.start, np.zeros(len(size), np.int64))[words]
    unknown = np.flatnonzero(words >= len(known.length))
    rare, rare_offsets = pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    if len(unknown):
        doc = np.searchsorted(offsets, unknown, side="right") - 1
        pair, at = np.unique(doc * len(size) + words[unknown] - len(known.length), return_inverse=True)
        pair_doc, pair_word = np.divmod(pair, len(size))
        short = size[pair_word] <= LONG
        rare = unknown_words.take(pa.array(pair_word[short]))
        rare_offsets[1:] = np.cumsum(np.bincount(pair_doc[short], minlength=len(offsets) - 1))
        extra = (rare_offsets[pair_doc] - np.cumsum(short)).astype(np.int32)  # -1 - its place among its text's rare ones
        own = np.ones(len(pair), np.int64)
        if not short.all():
            merged = {w: np.array(merge_long(unknown_words[w].as_py().encode(), ranks), np.int32) for w in np.flatnonzero(size > LONG)}
            parts = [extra[k : k + 1] if s else merged[w] for k, (s, w) in enumerate(zip(short, pair_word))]
            own, extra = np.array([len(p) for p in parts]), np.concatenate(parts)
        length[unknown] = own[at]
        start[unknown] = len(ids) + (np.cumsum(own) - own)[at]
        ids = np.concatenate([ids, extra])
    out = ids[ragged(start, length)]
    ends = np.append(0, np.cumsum(length))[offsets]
    return pa.StructArray.from_arrays([_list_array(ends, pa.array(out, pa.int32())), _list_array(rare_offsets, rare)], ["ids", "rare"])


def _splitter(shared, pattern: str):
    cut = cuts if pattern == BYTE_LEVEL else None

    def split(texts: pa.Array, known: Known, ranks: dict[bytes, int], find) -> pa.Array:
        """Ids of the known pretokens of each text; -1 - k for its k-th distinct rare one."""
        unique, number, begin = pieces(texts, cut)
        code = known.number(unique.cast(pa.string()))
        other = np.flatnonzero((code < 0) | (code >= known.whole))
        flat, n = _pretokens(unique.take(pa.array(other)), find)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        own = known.number(coded.dictionary)
        new = own < 0
        own[new] = len(known.length) + np.arange(new.sum())
        rare, own = coded.dictionary.filter(pa.array(new)), own[coded.indices.to_numpy()]
        length, start = np.ones(len(code), np.int64), np.arange(len(code))
        length[other], start[other] = n, len(code) + np.cumsum(n) - n
        length, start = length[number], start[number]
        offsets = np.append(0, np.cumsum(length))[begin]
        return _split(np.append(code, own)[ragged(start, length)], offsets, rare, known, ranks)

    @lean
    def run(batches):
        (known, ranks), find = shared.value, finder(pattern)
        for batch in batches:
            *kept, texts = batch.columns
            texts = pc.fill_null(texts, "")
            for lo, hi in steps(texts):
                out = split(texts.slice(lo, hi - lo), known, ranks, find)
                columns = [*(c.slice(lo, hi - lo) for c in kept), out.field("ids"), out.field("rare")]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__bpe_ids", "__bpe_rare"])

    return run


def _joined(ids: pa.Array, folded: pa.Array) -> pa.Array:
    """The ids with those of the rare pretokens in their places."""
    flat, offsets = _lists(ids)
    per_doc, first = _lists(folded)
    rare, begin = _lists(per_doc)
    flat, rare = flat.to_numpy(zero_copy_only=False), rare.to_numpy(zero_copy_only=False)
    marks = np.flatnonzero(flat < 0)
    if not len(marks):
        return ids
    doc = np.searchsorted(offsets, marks, side="right") - 1
    which = first[doc] - 1 - flat[marks]
    length, start = np.ones(len(flat), np.int64), np.arange(len(flat))
    length[marks] = np.diff(begin)[which]
    start[marks] = len(flat) + begin[which]
    out = np.concatenate([flat, rare])[ragged(start, length)]
    ends = np.append(0, np.cumsum(length))[offsets]
    return _list_array(ends, pa.array(out, pa.int32()))


def _id_bytes(ids: pa.Array) -> pa.Array:
    flat, offsets = _lists(ids)
    data = flat.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(data)])


def _decoded(ids: pa.Array, by_id: pa.Array) -> pa.Array:
    flat, offsets = _lists(ids)
    return pc.binary_join(_list_array(offsets, by_id.take(flat)), b"")


def _pieces_by_id(ranks: dict[bytes, int]) -> pa.Array:
    by_id = {r: t for t, r in ranks.items()}
    return pa.array([by_id.get(k, b"") for k in range(max(by_id) + 1)], pa.binary())


def _joiner(shared, more: list[str]):
    """Put the ids in place; ``more`` names id_bytes and decoded columns (or None)."""

    @lean
    def run(batches):
        by_id = shared.value
        for batch in batches:
            *kept, ids, folded = batch.columns
            for lo, hi in _slices(_lists(ids)[1]):
                own = _joined(ids.slice(lo, hi - lo), folded.slice(lo, hi - lo))
                columns = [*(c.slice(lo, hi - lo) for c in kept), own]
                columns += [f(own) for name, f in zip(more, (_id_bytes, lambda x: _decoded(x, by_id))) if name]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *filter(None, more)])

    return run


def decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """A function of a column of ids to the bytes that they stand for: the pieces of the ids, concatenated. An
    id without a token stands for none; null for null."""
    shared = spark.sparkContext.broadcast(_pieces_by_id(ranks))

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        whole = pc.fill_null(ids, []) if ids.null_count else ids
        parts = [_decoded(whole.slice(lo, hi - lo), shared.value) for lo, hi in _slices(_lists(whole)[1])]
        out = pa.concat_arrays([pa.array([], pa.binary()), *parts])
        return pc.if_else(ids.is_valid(), out, None) if ids.null_count else out

    return decode


def _counter(pattern: str):
    cut = cuts if pattern == BYTE_LEVEL else None

    @lean
    def run(batches):
        find = finder(pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for lo, hi in steps(texts):
                unique, number, _ = pieces(texts.slice(lo, hi - lo), cut)
                flat, n = _pretokens(unique, find)
                often = np.repeat(np.bincount(number, minlength=len(unique)), n)
                yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string()), pa.array(often, pa.int64())], names=["word", "n"])

    return run


def frequent(docs: DataFrame, pattern: str, most: int) -> DataFrame:
    """``word`` of the most frequent pretokens of ``docs(text)``: those counted often enough that ``most`` suffice."""
    counted = stored(
        docs.mapInArrow(_counter(pattern), "word string, n long")
        .where((F.octet_length("word") <= LONG) & (F.octet_length("word") > 1))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where("n > 1"),
        "bpe-counts",
    )
    by_count = counted.groupBy("n").agg(F.count("*").alias("words")).toPandas().sort_values("n", ascending=False)
    enough = by_count[by_count["words"].cumsum() <= most]["n"]  # one row for each count that occurs
    return counted.where(F.col("n") >= (int(enough.min()) if len(enough) else 1 << 62)).select("word")


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    out: str = "ids",
    id_bytes: str | None = None,
    decoded: str | None = None,
    keep: list[str] | None = None,
    hot: int = HOT,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``out``: the ids of ``text`` as an array of ints.
    ``id_bytes`` and ``decoded`` name two more columns: the ids as little-endian unsigned 32-bit integers, and the
    bytes that they decode to.

    A null text counts as empty and has no ids. Repeated rows and ties need no care: each row stands for
    itself. Columns of the new names are replaced; names that begin with ``__bpe_`` are not allowed. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    fold = Fold(spark, ranks)
    words = frequent(docs.select(text), pattern, hot)
    folded = fold.add(words.select("word", F.array("word").alias("own")), "own", "ids").select("word", F.get("ids", F.lit(0)).alias("ids"))
    known = Known(ranks, folded.toArrow(), finder(pattern))  # ``hot`` rows at most
    send = spark.sparkContext.broadcast
    more = [id_bytes, decoded]
    kept = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns) if c not in (out, id_bytes, decoded)])
    fields, ids = kept.schema.fields, T.StructField(out, _IDS)
    rare = T.StructField("__bpe_rare", T.ArrayType(T.StringType()))
    own = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).alias("__bpe_text"))
    parts = own.mapInArrow(_splitter(send((known, ranks)), pattern), T.StructType([*fields, T.StructField("__bpe_ids", _IDS), rare]))
    placed = fold.add(parts, "__bpe_rare", "__bpe_folded").withColumnRenamed("__bpe_ids", out).drop("__bpe_rare")
    schema = T.StructType([*fields, ids, *(T.StructField(c, T.BinaryType()) for c in more if c)])
    return placed.mapInArrow(_joiner(send(_pieces_by_id(ranks)), more), schema)
