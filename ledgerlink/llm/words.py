"""Texts of a batch as arrays: bytes, words and where they lie."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Words:
    """Words are longest runs of bytes other than the six ASCII white space characters."""

    data: np.ndarray  # UTF-8 bytes of all texts in a row
    starts: np.ndarray  # first byte of each text, and the end of the last
    begin: np.ndarray  # first byte of each word
    size: np.ndarray  # bytes of each word
    doc: np.ndarray  # text of each word
    code: np.ndarray  # the same number for the same word
    first: np.ndarray  # first word of each text, and the end of the last


def split(texts: list[str], lower: bool = False) -> Words:
    """Words of some texts; equal words get equal codes, from 0 on. ``lower`` lower-cases A to Z."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)])
    data = np.frombuffer(b"".join(coded), np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = _blank[data]
    edge = np.ones(len(data) + 1, bool)  # white space, or a text begins, before the byte
    edge[1:] = np.append(blank[:-1], True) if len(blank) else True
    if len(blank):
        edge[1:-1] = blank[:-1]
    edge[starts] = True
    begin = np.flatnonzero(~blank & edge[:-1]) if len(data) else np.zeros(0, np.int64)
    last = ~blank & np.append(blank[1:] | edge[1:-1], True) if len(data) else blank
    size = np.flatnonzero(last) + 1 - begin
    first = np.searchsorted(begin, starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    packed = data[~blank] if len(data) else data
    array = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    code = np.asarray(pc.dictionary_encode(array).indices) if len(begin) else np.zeros(0, np.int32)
    return Words(data, starts, begin, size, doc, code, first)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all their bits."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_windows(words: Words, n: int) -> np.ndarray:
    """For each word, whether a window of n words of its text that occurs there twice or more covers it."""
    many = len(words.code) - n + 1
    covered = np.zeros(len(words.code), bool)
    if many <= 0:
        return covered
    own = words.doc[:many] == words.doc[n - 1 :]
    key = mixed(words.doc[:many])
    for k in range(n):
        key = mixed(key + np.uint64(0x9E3779B97F4A7C15) + words.code[k : k + many].astype(np.uint64))
    at = np.flatnonzero(own)
    by = at[np.argsort(key[at], kind="stable")]
    same = key[by[1:]] == key[by[:-1]]
    equal = words.doc[by[1:]] == words.doc[by[:-1]]
    for k in range(n):
        equal &= words.code[by[1:] + k] == words.code[by[:-1] + k]
    if (same & ~equal).any():  # two windows with one key: order by the words themselves
        by = at[np.lexsort([*(words.code[at + k] for k in range(n)), words.doc[at]])]
        equal = words.doc[by[1:]] == words.doc[by[:-1]]
        for k in range(n):
            equal &= words.code[by[1:] + k] == words.code[by[:-1] + k]
    again = np.zeros(len(by), bool)
    again[1:] |= equal
    again[:-1] |= equal
    starts = by[again]
    for k in range(n):
        covered[starts + k] = True
    return covered


_byte_values = mixed(np.arange(1, 257).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
BASE = np.uint64(0x9E3779B97F4A7C15)
_base_powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(255, BASE)]))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word, the same in every batch."""
    if not len(w.begin):
        return np.zeros(0, np.uint64)
    blank = _blank[w.data]
    solid = w.data[~blank]
    ends = np.cumsum(w.size)
    begins = ends - w.size
    nth = np.arange(len(solid)) - np.repeat(begins, w.size)
    far, near = nth >> 8, nth & 255
    value = _byte_values[solid] * _base_powers[near]
    if far.any():  # words of over 256 bytes
        value = mixed(value + far.astype(np.uint64))
    return mixed(np.add.reduceat(value, begins) + w.size.astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n words in a row, by the first of them."""
    many = max(0, len(hashes) - n + 1)
    out = np.zeros(many, np.uint64)
    for k in range(n):
        out *= BASE
        out += hashes[k : k + many]
    return mixed(out)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n values in a row, by the first of them."""
    out, width = values, 1
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < n:
        out = np.minimum(out[: len(out) - (n - width)], out[n - width :])
    return out
