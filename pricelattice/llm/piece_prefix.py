"""SentencePiece encoding and decoding of merge-type models by a prefix table.

The merge rule (best score first, leftmost on ties) gives every prefix of a text one encoding, and the encoding of a
prefix without its last token is that of a shorter prefix. So it is enough to keep each prefix's last token. An automaton
lists the pieces that end at a character; the one that stands is compatible with the last token of the prefix before
it: merging the two alone would leave both. Ids are then read from the end backwards. The work is linear in
the text: no heap, no merges, no dependence on how long a word is.

Compatibility undoes the merges of both tokens from the last one back, along the right edge of the left one and the left
edge of the right one. Two pieces that stand beside each other on the way and that are a piece together must not
have been merged before one of them grew.

Texts are cut where white space begins, if no piece goes on over such a place; a worker remembers the ids of frequent
cuts (a cache of bounded size, in front of the same computation)."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

#: The library's sign for a space, its text for the unknown piece, and the sign for a byte that is no UTF-8.
SPACE, UNKNOWN_TEXT, BAD_BYTE = "▁", " ⁇ ", "�"
#: Cuts that a worker remembers, and the longest one of them; remembered pairs.
KEEP, SHORT, PAIRS = 1 << 18, 48, 1 << 20
#: Characters of text, or ids, of one output batch.
STEP = 1 << 19
_NEVER = float("inf")


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id, their scores, and which ids are ordinary pieces, bytes (id of byte 0), control and unknown ones."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[int, ...]
    byte_zero: int
    control: tuple[int, ...]
    unknown: int

    @cached_property
    def table(self) -> PrefixTable:
        return PrefixTable(self)


def read_model(path: str) -> PieceModel:
    """The model of a file, read on the driver. Raises for what the prefix table does not cover: other than merge models, text
    normalisation, models without byte fallback or dummy prefix, and user-defined or unused pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t, kinds = m.normalizer_spec, m.trainer_spec, [p.type for p in m.pieces]
    by = {k: tuple(i for i, x in enumerate(kinds) if x == k) for k in (1, 2, 3, 4, 5, 6)}  # normal, unknown, control, user, unused, byte
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    first = by[6][0] if by[6] else -1
    if t.model_type != t.BPE or not plain or t.treat_whitespace_as_suffix or by[4] or by[5] or len(by[2]) != 1 or by[6] != tuple(range(first, first + 256)):
        raise ValueError(f"{path} is no merge-type model with byte fallback, a dummy prefix and text as it is")
    return PieceModel(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), by[1], first, by[3], by[2][0])


class PrefixTable:
    """What encoding needs of a model: the automaton, and per piece the edges of its merges."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.id_of = {model.pieces[i]: i for i in model.ordinary}
        #: When a piece comes to be in the order of merges: better scores first; characters are there from the start.
        self.time = [-s for s in model.scores]
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.time[i] = -_NEVER
        self.letters = frozenset(c for p in self.id_of for c in p)
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        if any(c not in self.id_of for c in self.letters):
            raise ValueError("every character of a piece must be a piece")
        for p, i in self.id_of.items():
            parts = self._last_merge(p)
            if parts is None:
                continue  # no text is ever encoded with it
            if len(p) > 1:
                if max(self.time[k] for k in parts) > self.time[i]:
                    raise ValueError(f"the piece {p!r} comes before its parts")
                self.split[i] = parts
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in model.pieces]
        whole = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        #: Cuts that no piece goes over: white space and what follows it.
        self.cuts = None if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b in range(256):
            self.bytes_of[model.byte_zero + b] = bytes([b])
        for i in model.control:
            self.bytes_of[i] = b""
        self.bytes_of[model.unknown] = UNKNOWN_TEXT.encode()
        self.hidden = frozenset(model.control)

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces that are merged last where ``piece`` stands alone; None if its merges end before."""
        parts = [self.id_of[c] for c in piece]
        if len(parts) == 1:
            return parts[0], parts[0]
        while len(parts) > 2:
            text = [self.model.pieces[i] for i in parts]
            found = [(self.time[m], k, m) for k in range(len(parts) - 1) if (m := self.id_of.get(text[k] + text[k + 1])) is not None]
            if not found:
                return None
            _, k, m = min(found)
            parts[k : k + 2] = [m]
        return parts[0], parts[1]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives just these tokens."""
        time, split, pieces, id_of = self.time, self.split, self.model.pieces, self.id_of
        left_grows = right_grows = _NEVER  # when each one is merged further inside its token
        while True:
            both = id_of.get(pieces[left] + pieces[right])
            # what stands left of the boundary is merged first on ties, what stands right of it last
            if both is not None and time[both] < left_grows and time[both] <= right_grows:
                return False
            if time[left] > time[right] and left in split:
                left_grows, left = time[left], split[left][1]
            elif right in split:
                right_grows, right = time[right], split[right][0]
            elif left in split:
                left_grows, left = time[left], split[left][1]
            else:
                return True

    def last_tokens(self, run: str) -> list[int]:
        """Per prefix of ``run`` (known characters alone) its last token; 0 for the empty one."""
        last, length, pairs = [-1] * (len(run) + 1), self.length, self.pairs
        for end, token in self.automaton.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start:
                key = last[start] << 32 | token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    good = pairs[key] = self.fits(last[start], token)
                if not good:
                    continue
            last[end] = token
        return last

    def _run(self, run: str, out: array) -> None:
        """The ids of ``run``, read from its end backwards."""
        last, length, p, own = self.last_tokens(run), self.length, len(run), []
        while p:
            token = last[p]
            own.append(token)
            p -= length[token]
        own.reverse()
        out.extend(own)

    def cut_ids(self, cut: str) -> bytes:
        """Ids of a cut as 32-bit numbers; a character of no piece is the ids of its bytes."""
        out = array("i")
        if self.letters.issuperset(cut):
            self._run(cut, out)
        else:
            begin = 0
            for k, c in enumerate(cut):
                if c not in self.letters:
                    if k > begin:
                        self._run(cut[begin:k], out)
                    out.extend(self.model.byte_zero + b for b in c.encode())
                    begin = k + 1
            if begin < len(cut):
                self._run(cut[begin:], out)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        known, out = self.known, []
        for cut in self.cuts.findall(marked) if self.cuts else [marked]:
            ids = known.get(cut)
            if ids is None:
                ids = self.cut_ids(cut)
                if len(cut) <= SHORT:
                    if len(known) >= KEEP:
                        known.clear()
                    known[cut] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first piece loses its leading space; bytes that are no UTF-8 become a sign each."""
        first = next((k for k, i in enumerate(ids) if i not in self.hidden), len(ids))
        raw = [self.bytes_of[i] for i in ids]
        if first < len(ids) and self.model.pieces[ids[first]].startswith(SPACE):
            raw[first] = raw[first][1:]
        try:
            if self.hidden.isdisjoint(ids):  # a control id parts the bytes of a character
                return b"".join(raw).decode()
        except UnicodeDecodeError:
            pass
        low, out, run = self.model.byte_zero, [], []
        for i, b in zip(ids, raw):
            if low <= i < low + 256:
                run.append(b)
                continue
            out += [_lenient(b"".join(run)), b.decode()]
            run = []
        return "".join([*out, _lenient(b"".join(run))])


def _lenient(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), BAD_BYTE]
            raw = raw[e.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=2)
def _table(model: PieceModel) -> PrefixTable:
    """One table a worker."""
    return model.table


def _spans(sizes: list[int], most: int):
    """Ranges of rows of about ``most`` in total; a row is never parted."""
    lo = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most or k + 1 == len(sizes):
            yield lo, k + 1
            lo, held = k + 1, 0


def _added(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    gone = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in gone] + list(fields))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", out: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with the ids of ``text`` in ``out`` (array of int), and in ``decoded`` what they decode to.

    Without begin and end ids; a null or empty text has no ids. Columns that are already called ``out`` or ``decoded`` are replaced. A very
    long text is one row of one batch; texts are encoded whole. Repeated rows stay repeated; an empty table gives an empty one."""
    own = [text, *[c for c in (docs.columns if keep is None else keep) if c != text]]
    plain = docs.select(*[f"`{c}`" for c in own])
    asked = [T.StructField(out, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    rest = T.StructType([f for f in plain.schema if keep is None or f.name in keep])
    schema = _added(rest, *asked)
    held = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary
    passed = [f.name for f in schema.fields[: len(schema.fields) - len(asked)]]

    @lean
    def run(batches):
        table = _table(held.value)
        for batch in batches:
            texts = batch.column(text)
            for lo, hi in _spans(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), STEP):
                raw = [table.encode(x or "") for x in texts[lo:hi].to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in raw]], dtype=np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    ids = flat.tolist()
                    new.append(pa.array([table.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in passed], *new], names=[f.name for f in schema])

    return plain.mapInArrow(run, schema)


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``out`` (null for null ids). A null or unknown id raises."""
    schema = _added(rows.schema, T.StructField(out, T.StringType()))
    held = rows.sparkSession.sparkContext.broadcast(model)
    passed = [f.name for f in schema.fields[:-1]]

    @lean
    def run(batches):
        table = _table(held.value)
        for batch in batches:
            lists = batch.column(ids)
            for lo, hi in _spans(pc.fill_null(pc.list_value_length(lists), 0).to_pylist(), STEP):
                texts = []
                for x in lists[lo:hi].to_pylist():
                    if x is not None and any(i is None or not 0 <= i < len(table.bytes_of) for i in x):
                        raise ValueError("an id of no piece")
                    texts.append(None if x is None else table.decode(x))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in passed], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
