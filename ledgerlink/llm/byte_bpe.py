"""Byte-level BPE by the ranks of a vocabulary file.

A text is cut by the vocabulary's pattern; each piece is merged on its own. A piece of n bytes has
n - 1 neighbouring pairs, whose ranks are the leaves of a segment tree. The root holds the lowest
rank; going down to the left child wherever it holds the same value finds the leftmost pair of that
rank. A merge takes its pair and changes the two neighbouring pairs: three point updates of
logarithmic length, so a piece of any length takes O(n log n).

Texts are encoded where they are read; nothing is shuffled. Pieces that were merged before come
from a bounded cache of the worker; new short ones are merged side by side, in arrays.
"""

from __future__ import annotations

import base64
import gc
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, steps, table

NO_PAIR = 1 << 40
NO_RANK = (1 << 31) - 1

#: Pieces that a worker remembers, and the longest one, in characters.
CACHE_PIECES = 600_000
CACHE_LENGTH = 48
#: Characters of text encoded together: the more, the more new pieces are merged side by side.
PART_CHARS = 2_000_000
#: Leaves of the largest trees that are worked side by side.
MOST_LEAVES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Ranks with the merge; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"no rank for the bytes {lacking[:5]}")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks, longest = self.ranks, self.longest
        whole = ranks.get(piece)
        if whole is not None or not piece:
            return [] if whole is None else [whole]
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        tree = [NO_PAIR] * (2 * leaves)
        get = ranks.get
        for i in range(n - 1):
            tree[leaves + i] = get(piece[i : i + 2], NO_PAIR)
        for k in range(leaves - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        end = list(range(1, n + 1))  # where the live token that starts here ends
        before = list(range(-1, n - 1))  # start of the live token before

        def put(at: int, rank: int) -> None:
            k = leaves + at
            tree[k] = rank
            while k > 1:
                k >>= 1
                left, right = tree[2 * k], tree[2 * k + 1]
                low = left if left <= right else right
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != NO_PAIR:
            lowest, k = tree[1], 1
            while k < leaves:
                k *= 2
                if tree[k] != lowest:
                    k += 1
            first = k - leaves
            second = end[first]
            stop = end[second]
            end[first] = stop
            put(second, NO_PAIR)
            if stop < n:
                before[stop] = first
                past = end[stop]
                put(first, get(piece[first:past], NO_PAIR) if past - first <= longest else NO_PAIR)
            else:
                put(first, NO_PAIR)
            left = before[first]
            if left >= 0:
                put(left, get(piece[left:stop], NO_PAIR) if stop - left <= longest else NO_PAIR)
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out


class Encoder:
    """Encodes texts in a worker; remembers merged pieces.

    New pieces of up to MOST_LEAVES + 1 bytes are merged side by side: one segment tree per piece, as
    rows of an array, and one merge of each piece at a time.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.merger = Merger(load_ranks(path))
        ranks = self.merger.ranks
        pairs = [
            (ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        pairs.sort()
        #: Token pairs, as one number, and the rank of what they merge to.
        self.pairs = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of pairs of tokens; NO_RANK for those that don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NO_RANK).astype(np.int32)

    def merge_all(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids of pieces of 2 to ``leaves`` + 1 bytes."""
        n = np.array([len(p) for p in pieces])
        many = len(pieces)
        flat = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(many), n)
        ids = np.zeros((many, leaves + 2), np.int32)
        ids[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        after = np.tile(np.arange(1, leaves + 3), (many, 1))
        before = np.tile(np.arange(-1, leaves + 2), (many, 1))
        tree = np.full((many, 2 * leaves), NO_RANK, np.int32)
        pair = np.arange(leaves) < n[:, None] - 1
        tree[:, leaves:][pair] = self.rank_of(ids[:, :leaves][pair], ids[:, 1 : leaves + 1][pair])
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] != NO_RANK)
        while len(rows):
            lowest = tree[rows, 1]
            at = np.ones(len(rows), np.int64)
            for _ in range(leaves.bit_length() - 1):
                at *= 2
                at += tree[rows, at] != lowest
            first = at - leaves
            second = after[rows, first]
            stop = after[rows, second]
            ids[rows, first] = lowest
            after[rows, first] = stop
            before[rows, stop] = first
            inner = stop < n[rows]
            ahead = np.where(inner, self.rank_of(lowest, ids[rows, np.where(inner, stop, 0)]), NO_RANK)
            left = before[rows, first]
            has_left = left >= 0
            behind = self.rank_of(ids[rows, np.maximum(left, 0)], lowest)
            self.put(tree, rows, second, np.int32(NO_RANK), leaves)
            self.put(tree, rows, first, ahead, leaves)
            self.put(tree, rows[has_left], left[has_left], behind[has_left], leaves)
            rows = rows[tree[rows, 1] != NO_RANK]
        out = []
        live = np.zeros((many, leaves + 2), bool)
        place = np.zeros(many, np.int64)
        rows = np.arange(many)
        while len(rows):
            live[rows, place[rows]] = True
            place[rows] = after[rows, place[rows]]
            rows = rows[place[rows] < n[rows]]
        ends = np.cumsum(live.sum(1)) * 4
        blob = ids[live].tobytes()
        begin = 0
        for end in ends.tolist():
            out.append(blob[begin:end])
            begin = end
        return out

    @staticmethod
    def put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank, leaves: int) -> None:
        """Set one leaf of each row and the minima above it; a place without a leaf is left out."""
        real = at < leaves
        if not real.all():
            rows, at = rows[real], at[real]
            rank = rank[real] if np.ndim(rank) else rank
        k = at + leaves
        tree[rows, k] = rank
        while leaves > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            leaves >>= 1

    def learn(self, new: set[str]) -> None:
        """Merge pieces that are not known."""
        ranks = self.merger.ranks
        waiting: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in new:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
                continue
            leaves = max(4, 1 << (len(raw) - 2).bit_length())
            if leaves > MOST_LEAVES:
                self.known[piece] = np.array(self.merger.merge(raw), np.int32).tobytes()
                continue
            names, raws = waiting.setdefault(leaves, ([], []))
            names.append(piece)
            raws.append(raw)
        for leaves, (names, raws) in waiting.items():
            self.known.update(zip(names, self.merge_all(raws, leaves)))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        gc.disable()  # nothing here makes cycles, and walking all pieces again and again takes long
        try:
            return self.coded(texts)
        finally:
            gc.enable()

    def coded(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = set(chain.from_iterable(split))
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for piece in [p for p in new if len(p) > CACHE_LENGTH]:
            del self.known[piece]
        return out


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; the vocabulary is a file that every machine has."""
    key = (path, pattern, os.path.getmtime(path))
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in a row; start and length of each id's bytes, length -1 for no token."""
    if path not in _decoders:
        ranks = load_ranks(path)
        size = max(ranks.values(), default=-1) + 1
        start, length = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        blob = bytearray()
        for token, rank in ranks.items():
            start[rank], length[rank] = len(blob), len(token)
            blob += token
        _decoders[path] = (np.frombuffer(bytes(blob), np.uint8), start, length)
    return _decoders[path]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column as ``array<int>``; NULL and empty texts give an empty array."""
    small_batches()

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        try:
            for texts in batches:
                yield coded_lists(enc, texts)
        finally:
            enc.known.clear()  # the worker goes on to other stages

    return ids_of(text)


def coded_lists(enc: Encoder, texts: pa.Array) -> pa.ListArray:
    """Ids of each text of an array."""
    bodies, sizes = [], [0]
    for part in steps(texts, PART_CHARS):
        coded = enc.texts(part)
        sizes += [len(b) // 4 for b in coded]
        bodies.append(b"".join(coded))
    values = pa.array(np.frombuffer(b"".join(bodies), np.int32))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)


def decoded_lists(path: str, lists: pa.Array) -> pa.Array:
    """Bytes of each list of ids."""
    blob, start, length = vocabulary(path)
    values = np.asarray(lists.flatten())
    if len(values) and (values.min() < 0 or values.max() >= len(length) or (length[values] < 0).any()):
        raise ValueError("an id is outside the vocabulary")
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    out, at = [], 0
    for n, known in zip(sizes.tolist(), lists.is_valid().to_pylist()):
        part = values[at : at + n]
        at += n
        many = length[part]
        ends = np.cumsum(many)
        total = int(ends[-1]) if n else 0
        where = np.repeat(start[part] - (ends - many), many) + np.arange(total)
        out.append(blob[where].tobytes() if known else None)
    return pa.array(out, pa.binary())


def decode(ids: Column, path: str) -> Column:
    """Bytes of an id column; NULL gives NULL, an id outside the vocabulary is an error."""
    small_batches()

    @F.arrow_udf("binary")
    def bytes_of(lists: pa.Array) -> pa.Array:
        return decoded_lists(path, lists)

    return bytes_of(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """A struct of ``encode``'s ids and the bytes that ``decode`` makes of them.

    Both are done by one worker of a task, so a task holds one vocabulary and one set of buffers.
    """
    small_batches()

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        try:
            for texts in batches:
                ids = coded_lists(enc, texts)
                yield pa.StructArray.from_arrays([ids, decoded_lists(path, ids)], ["ids", "decoded"])
        finally:
            enc.known.clear()

    return both_of(text)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents`` and the bytes that they decode to, as digests."""
    import public_tokenizers as vocabularies

    return digests(
        table(spark, sf_dir, "documents"),
        vocabularies.path("byte_bpe_50k.tiktoken"),
        vocabularies.PATTERN,
    )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``, repeated rows included; a NULL text counts as empty."""
    coded = docs.select("doc_id", encode(docs["text"], path, pattern).alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
