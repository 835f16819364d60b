"""Cutting many texts at once where the byte-level pre-tokeniser is sure to end a pretoken."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern of byte-level pretokens that ``cuts`` is made for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text handled at once.
STEP = 1 << 21
#: Classes of bytes: 0 unknown, 1 letter, 2 digit, 3 punctuation.
_CLASS = np.array(
    [1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 0x20 < b < 0x7F else 0 for b in range(128)] + [0] * 128, np.uint8
)
#: First bytes of two-byte letters (U+00C0 to U+023F; two signs are excepted below).
_LATIN = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8])
#: Bytes that may begin white space, controls included.
_MAYBE_SPACE = np.array([b <= 0x20 or b in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text of these UTF-8 bytes may be cut before each, so that the parts have the
    pretokens of the whole. The pattern looks ahead only for white space after white space, so it may
    be cut: before a space that no white space follows; where letters, digits and punctuation meet,
    but not after an apostrophe; around a line feed between plain characters."""
    kind = _CLASS[data]
    two = np.flatnonzero(_LATIN[data[:-1]]) if len(data) else np.zeros(0, np.int64)
    two = two[(data[two] != 0xC3) | ((data[two + 1] != 0x97) & (data[two + 1] != 0xB7))]
    kind[two] = kind[two + 1] = 1
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    plain = kind > 0
    out[1:] = plain[1:] & plain[:-1] & (kind[1:] != kind[:-1]) & (data[:-1] != 0x27)
    space = np.flatnonzero(data[:-1] == 0x20)
    out[space] = ~_MAYBE_SPACE[data[space + 1]]
    feed = np.flatnonzero(data[1:-1] == 0x0A) + 1
    feed = feed[plain[feed - 1] & plain[feed + 1]]
    out[feed] = out[feed + 1] = True
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, ``length`` places, one after the other."""
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(int(length.sum()))


def steps(texts: pa.Array):
    """Ranges of whole texts (without nulls) of about STEP bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP, side="right")))
        yield lo, hi
        lo = hi


def pieces(texts: pa.Array, cut=cuts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces as binary, the number of each piece of the texts, where each text begins among
    them and where the last ends). ``cut=None``: a text is a piece."""
    data, offsets = np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if len(texts) and texts.buffers()[2] is not None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
    begins = cut(data) if cut else np.zeros(len(data), bool)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    begins[last[data[last] <= 0x20]] = False  # white space at an end: what the cut there has seen belongs to the next text
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.append(np.flatnonzero(begins), len(data))
    own = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    coded = own.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, offsets)
