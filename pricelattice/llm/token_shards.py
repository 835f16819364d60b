"""Token-id output in shards compressed by Re-Pair grammars.

Documents are sorted by id over a range partitioning. Each task encodes its documents, appends the
end id to each, and packs whole documents into shards of about ``SHARD`` ids. A shard's ids are
compressed by Re-Pair: in each round all adjacent pairs are counted exactly and the frequent ones
become nonterminals, the more frequent pair first where two overlap (of equal ones that of the least
hash, so that a chain of overlapping pairs takes few rounds). Rounds go on until no pair occurs
``LEAST_COUNT`` times, the number from which a rule is no larger than what it saves. No rule spans
two documents. A shard is one binary value:

    magic "RPS2" | uint32: terminals, rules, documents, bits of a length | uint64: ids of this task before it, symbols
    documents: int64 id (least for null), uint64 first symbol, uint64 ids
    rules: 2 symbols each | expansion length of each rule | symbols

all little-endian. Symbols and lengths are packed in as few bits as the greatest needs, least bit
first; each of the three lists ends at a whole byte. With the expansion lengths, a reader finds any
range of ids of a document and expands only the symbols that cover it. Shards are rows (part, shard, content) of a Parquet
folder, so that the writer's commit holds when executors are lost.
"""

from __future__ import annotations

import struct
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, shared_dir
from .pretokens import pieces, ragged, steps

MAGIC = b"RPS2"
_HEAD = struct.Struct("<4sIIIIQQ")
_DOC = np.dtype([("id", "<i8"), ("first", "<u8"), ("n", "<u8")])
NULL_ID = -(1 << 63)
SHARD = 1 << 20
#: A rule takes the bits of two symbols and of its length, less than three symbols.
LEAST_COUNT = 4
#: A round takes the pairs that occur at least this part as often as the most frequent one.
SPREAD = 64
_SLOTS = 20
#: Values packed at once, a multiple of 8.
BLOCK = 1 << 16
#: Pieces that a Python worker remembers, and the longest of them in bytes.
KEEP, KEEP_BYTES = 600_000, 64


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    key = np.sort(key)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begin], np.diff(np.append(begin, len(key)))


def _round(seq: np.ndarray, last: np.ndarray, live: np.ndarray):
    """Places whose pair is to be replaced, the pair of each (its number among those used), and the
    pairs used as rows. None of the places overlap, and no pair is used under LEAST_COUNT times. Takes
    from ``live`` the places whose pair is not frequent: it never will be, unless a new symbol comes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    free = live[:-1] & ~last[:-1]
    same = np.flatnonzero((seq[:-1] == seq[1:]) & ~last[:-1])
    if len(same):  # in a run of one symbol every other pair counts
        begin = np.maximum.accumulate(np.where(np.append(True, np.diff(same) > 1), np.arange(len(same)), 0))
        free[same[(np.arange(len(same)) - begin) % 2 == 1]] = False
    places = np.flatnonzero(free)
    if not len(places):
        return none
    key = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[places + 1]
    keys, n = _counted(key)
    often = n >= LEAST_COUNT
    if not often.any():
        return none
    keys, n = keys[often], n[often]
    order = np.lexsort((_mixed(keys), -n))
    keys, n = keys[order], n[order]  # a pair's number is now its rank
    table = np.full(1 << _SLOTS, -1, np.int32)
    table[_slot(keys)[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]  # pairs of one slot: the first now, others later
    pair = table[_slot(key)]
    live[places[pair < 0]] = False
    now = int(np.searchsorted(-n, -max(LEAST_COUNT, n[0] // SPREAD), side="right"))
    hit = np.flatnonzero((pair >= 0) & (pair < now))
    hit = hit[keys[pair[hit]] == key[hit]]
    places, pair = places[hit], pair[hit]
    before = (np.diff(places, prepend=-2) == 1) & (np.append(len(keys), pair[:-1]) < pair)
    after = (np.diff(places, append=places[-1] + 2) == 1) & (np.append(pair[1:], len(keys)) < pair)
    wins = ~(before | after)
    places, pair = places[wins], pair[wins]
    used = np.bincount(pair, minlength=len(keys)) >= LEAST_COUNT
    number = np.cumsum(used) - 1
    keep = used[pair]
    pairs = np.stack([keys[used] >> np.uint64(32), keys[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
    return places[keep], number[pair[keep]], pairs


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int):
    """Re-Pair over the documents of ``lengths`` ids: (symbols, symbols per document, rules,
    expansion lengths)."""
    seq = ids.astype(np.uint32)
    last, live = np.zeros(len(seq), bool), np.ones(len(seq), bool)
    last[np.cumsum(lengths) - 1] = True
    rules, size, n = [], np.ones(terminals, np.int64), terminals
    while len(seq) > 1:
        places, number, pairs = _round(seq, last, live)
        if not len(places):
            break
        seq[places] = n + number
        last[places] |= last[places + 1]
        live[places] = True
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, last, live = seq[keep], last[keep], live[keep]
        fresh = np.flatnonzero(seq >= n)
        live[fresh] = live[np.maximum(fresh - 1, 0)] = True
        size = np.append(size, size[pairs[:, 0]] + size[pairs[:, 1]])
        rules.append(pairs)
        n += len(pairs)
    ends = np.flatnonzero(last)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq, np.diff(np.append(-1, ends)), table, size[terminals:]


def _bits(values: np.ndarray, width: int) -> bytes:
    """``values`` in ``width`` bits each, blocks of which end at whole bytes."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    blocks = (np.unpackbits(raw[k : k + BLOCK], axis=1, count=width, bitorder="little") for k in range(0, len(raw), BLOCK))
    return b"".join(np.packbits(x, bitorder="little").tobytes() for x in blocks)


def _values(content: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    """``n`` values of ``width`` bits from byte ``at`` on, and the byte after them."""
    out = np.empty(n, np.int64)
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        packed = np.frombuffer(content, np.uint8, -(-m * width // 8), at + k * width // 8)
        bits = np.zeros((m, 32), np.uint8)
        bits[:, :width] = np.unpackbits(packed, count=m * width, bitorder="little").reshape(m, width)
        out[k : k + m] = np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, 0]
    return out, at + -(-n * width // 8)


def _width(greatest: int) -> int:
    return max(1, int(greatest).bit_length())


def pack(doc_ids: list[int], ids: np.ndarray, lengths: np.ndarray, before: int, terminals: int) -> bytes:
    seq, symbols, rules, sizes = compress(ids, lengths, terminals)
    docs = np.zeros(len(doc_ids), _DOC)
    docs["id"], docs["first"], docs["n"] = doc_ids, np.cumsum(symbols) - symbols, lengths
    width, of_size = _width(terminals + len(rules) - 1), _width(sizes.max(initial=0))
    head = _HEAD.pack(MAGIC, terminals, len(rules), len(docs), of_size, before, len(seq))
    return b"".join([head, docs.tobytes(), _bits(rules.ravel(), width), _bits(sizes, of_size), _bits(seq, width)])


class Shard:
    """Reader of one packed shard."""

    def __init__(self, content: bytes):
        magic, self.terminals, n_rules, n_docs, of_size, self.before, n_symbols = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.docs = np.frombuffer(content, _DOC, n_docs, _HEAD.size)
        width = _width(self.terminals + n_rules - 1)
        flat, at = _values(content, _HEAD.size + _DOC.itemsize * n_docs, 2 * n_rules, width)
        self.rules = flat.reshape(-1, 2)
        sizes, at = _values(content, at, n_rules, of_size)
        self.sizes = np.append(np.ones(self.terminals, np.int64), sizes)
        self.symbols, _ = _values(content, at, n_symbols, width)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while (symbols >= self.terminals).any():
            twice = symbols >= self.terminals
            out = np.repeat(symbols, 1 + twice)
            at = np.flatnonzero(twice) + np.arange(twice.sum())
            pair = self.rules[symbols[twice] - self.terminals]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype("<u4")

    def ids(self) -> np.ndarray:
        """All ids of the shard. The expansions of all symbols are laid out once, a layer of rules
        over those before it at a time, then gathered."""
        where = np.cumsum(self.sizes) - self.sizes
        flat = np.zeros(int(self.sizes.sum()), "<u4")
        flat[: self.terminals] = np.arange(self.terminals)
        newest = self.rules.max(axis=1) if len(self.rules) else np.zeros(0, np.int64)
        done = 0
        while done < len(self.rules):
            later = np.flatnonzero(newest[done:] >= self.terminals + done)
            stop = done + int(later[0]) if len(later) else len(self.rules)
            both = self.rules[done:stop].ravel()
            lo, hi = where[self.terminals + done], where[self.terminals + stop - 1] + self.sizes[self.terminals + stop - 1]
            flat[lo:hi] = flat[ragged(where[both], self.sizes[both])]
            done = stop
        return flat[ragged(where[self.symbols], self.sizes[self.symbols])]

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``doc`` (place in the shard), by random access."""
        first = int(self.docs["first"][doc])
        end = int(self.docs["first"][doc + 1]) if doc + 1 < len(self.docs) else len(self.symbols)
        own = self.symbols[first:end]
        ends = np.cumsum(self.sizes[own])
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        skipped = int(ends[lo - 1]) if lo else 0
        return self._expand(own[lo : hi + 1])[start - skipped : max(start, stop) - skipped]


class Encoder:
    """The tokenizer of one Python worker, with the ids of the pieces that it has met, over all its
    tasks. The memory only saves work: a full one is emptied."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # how a space is spelt
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learnt(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of new pieces. Those with a space at their front alone go
        through the library many in a text."""
        simple = [p.rfind(b" ") == 0 for p in new]
        spaced = [p for p, s in zip(new, simple) if s]
        parts, sizes = [], []
        for lo in range(0, len(spaced), 1024):
            some = spaced[lo : lo + 1024]
            ids = np.array(self._each([b"".join(some).decode()])[0], np.uint32)
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(some):  # a piece that the vocabulary spells otherwise
                each = self._each([p.decode() for p in some])
                ids, begin = np.array([i for e in each for i in e], np.uint32), np.cumsum([0, *map(len, each)])[:-1]
            parts.append(ids)
            sizes.append(np.diff(np.append(begin, len(ids))))
        each = self._each([p.decode() for p, s in zip(new, simple) if not s])
        flat = np.concatenate([*parts, np.array([i for e in each for i in e], np.uint32)])
        size = np.concatenate([*sizes, np.array([len(e) for e in each], np.int64)]).astype(np.int64)
        start = np.cumsum(size) - size
        order = np.argsort(~np.array(simple, bool), kind="stable")  # where each piece of flat comes from
        back = np.empty(len(new), np.int64)
        back[order] = np.arange(len(new))
        return flat[ragged(start[back], size[back])], size[back]

    def _numbers(self, unique: list[bytes]) -> np.ndarray:
        """Place of each piece in ``start`` and ``length``, unknown pieces learnt."""
        found = list(map(self.pieces.get, unique, repeat(-1)))
        if -1 in found and len(self.pieces) + found.count(-1) > KEEP:
            self._empty()
            found = [-1] * len(unique)
        at = np.array(found, np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            own = [unique[k] for k in new]
            ids, size = self._learnt(own)
            first = len(self.length)
            at[new] = first + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.length = np.concatenate([self.length, size])
            self.ids = np.concatenate([self.ids, ids])
            self.pieces.update((p, first + k) for k, p in enumerate(own) if len(p) <= KEEP_BYTES)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without nulls) one after the other, and the number of ids of each."""
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(~special)
        unique, number, begin = pieces(texts.take(pa.array(cut)) if special.any() else texts)
        number = self._numbers(unique.to_numpy(zero_copy_only=False).tolist())[number]
        length = self.length[number]
        ids, n = self.ids[ragged(self.start[number], length)], np.diff(np.append(0, np.cumsum(length))[begin])
        if not special.any():
            return ids, n
        whole = self._each([t.as_py() for t, s in zip(texts, special) if s])
        sizes = np.zeros(len(texts), np.int64)
        sizes[cut], sizes[special] = n, [len(w) for w in whole]
        flat = np.concatenate([ids, np.array([i for w in whole for i in w], np.uint32)])
        start = np.zeros(len(texts), np.int64)
        start[cut] = np.cumsum(n) - n
        start[special] = len(ids) + np.cumsum(sizes[special]) - sizes[special]
        return flat[ragged(start, sizes)], sizes


def _runs(batches):
    """(ids, texts) of whole documents, some at a time; null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for lo, hi in steps(texts):
            yield batch.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo)


def _writer(path: str, end_id: int, terminals: int):
    @lean
    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        docs, parts, sizes, held = [], [], [], 0
        encoder = Encoder.of(path)

        def flush():
            nonlocal shard, before, docs, parts, sizes, held
            ids = np.concatenate(parts)
            content = pack(docs, ids, np.concatenate(sizes), before, terminals)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_ids": len(ids), "content": content}], SHARDS)
            shard, before, docs, parts, sizes, held = shard + 1, before + len(ids), [], [], [], 0
            return row

        for doc_ids, texts in _runs(batches):
            ids, n = encoder.encode(texts)
            ends = np.cumsum(n)
            both = np.insert(ids, ends, end_id)  # the end id after the last of each
            ends = ends + np.arange(1, len(n) + 1)
            lo = 0
            while lo < len(n):  # a shard is full with the document that takes it to SHARD ids
                done = int(ends[lo - 1]) if lo else 0
                hi = min(len(n), int(np.searchsorted(ends, done + SHARD - held)) + 1)
                docs += doc_ids[lo:hi]
                parts.append(both[done : ends[hi - 1]])
                sizes.append(n[lo:hi] + 1)
                held += int(ends[hi - 1]) - done
                lo = hi
                if held >= SHARD:
                    yield flush()
        if docs:
            yield flush()

    return run


SHARDS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Encode ``text`` with the tokenizers file ``tokenizer`` and write shards in ascending order of
    ``id_col``, an integer (null first; equal ids by the hash of their text).

    A null or empty text is the end id alone. Repeated rows are written as often as they come. An
    empty table writes an empty folder. Other columns are ignored."""
    from tokenizers import Tokenizer

    terminals = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    schema = "part long, shard long, n_ids long, content binary"
    ordered.mapInArrow(_writer(tokenizer, end_id, terminals), schema).write.parquet(folder)


@lean
def _reader(batches):
    for batch in batches:
        for base, content in zip(batch["base"], batch["content"], strict=True):
            shard = Shard(content)
            ids, n = shard.ids(), shard.docs["n"].astype(np.int64)
            begin = np.cumsum(n) - n
            view = memoryview(ids.tobytes())
            yield pd.DataFrame(
                {
                    "doc_id": pd.Series(shard.docs["id"].astype(np.int64), dtype="Int64").where(shard.docs["id"] != NULL_ID),
                    "start": base + shard.before + begin,
                    "n_tokens": n,
                    "ids_crc32": [zlib.crc32(view[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)],
                }
            )


def read_shards(spark, folder: str) -> DataFrame:
    """One row per document of a folder of shards: ``doc_id``, ``start`` (ids before it),
    ``n_tokens``, ``ids_crc32`` of its ids as little-endian uint32."""
    shards = spark.read.schema("part long, shard long, n_ids long, content binary").parquet(folder)
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # one row per task of the writer, so small enough to send whole
    rows = shards.select("part", "content").join(F.broadcast(base), "part").select("base", "content")
    return rows.mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
