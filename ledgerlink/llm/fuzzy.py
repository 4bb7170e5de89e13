"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk wherever its low bits are zero, so an edit
moves only the boundaries near it. Each chunk gives one character of a signature, by a hash of its
bytes. The number of low bits (the level) is the lowest at which the text has at most SIGNATURE
chunks; a stretch of LONGEST times the mean chunk without a boundary is cut by length, which keeps
repetitive texts from ending in one chunk. A fingerprint is ``level:signature:signature at the next
level``. Two fingerprints are compared at the levels that they share, by the edit distance (with
insertions and deletions) of their signatures, which a bit-parallel pass computes for many pairs.

The edited text of a document needs the document that follows in ascending order of id. Documents
go to ranges of their id, each range with a copy of the next range's first document, and each task
reads its range in order with one document of look-ahead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bounds, range_of, small_batches, steps, table, tasks

#: Bytes that the rolling hash sees.
WINDOW = 7
#: Characters of a signature at most.
SIGNATURE = 64
#: Mean chunks after which a chunk without a boundary is cut.
LONGEST = 4
#: Signatures without a common run of so many characters (or of the shorter one) are unlike.
COMMON_RUN = 5

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_symbols = np.frombuffer(ALPHABET.encode(), np.uint8)
_place = np.full(128, -1, np.int64)
_place[_symbols] = np.arange(64)

_PRIME = np.uint64(0x100000001B3)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """_PRIME to the powers below n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        got = np.full(size, _PRIME, np.uint64)
        got[0] = 1
        _powers[0] = np.multiply.accumulate(got)
    return _powers[0]


def zero_bits(data: np.ndarray) -> np.ndarray:
    """Number of low zero bits of the mixed rolling hash at each byte, 31 at most."""
    n = len(data)
    rolling = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, n)):
        rolling[k:] += wide[: n - k] * np.uint32(pow(0x01000193, k, 1 << 32))
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x2C1B3C6D)
    rolling ^= rolling >> np.uint32(12)
    low = rolling & (~rolling + np.uint32(1))
    return np.where(low == 0, 31, np.log2(np.maximum(low, 1).astype(np.float32))).astype(np.int8)


def boundaries(zeros: np.ndarray, level: int) -> np.ndarray:
    """Ends of the chunks, the last one included."""
    n = len(zeros)
    ends = np.flatnonzero(zeros >= level) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    longest = LONGEST << level
    begins = np.concatenate([[0], ends[:-1]])
    pieces = (ends - begins + longest - 1) // longest
    if (pieces == 1).all():
        return ends
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = np.repeat(begins, pieces) + (nth + 1) * longest
    return np.minimum(cut, np.repeat(ends, pieces))


def signature(data: np.ndarray, ends: np.ndarray) -> str:
    """One character per chunk, by a polynomial hash of its bytes alone."""
    p = powers(len(data) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    # Read backwards, so that the power of a byte counts from its chunk's end after a shift.
    weighted = (data.astype(np.uint64) + np.uint64(1)) * p[len(data) - 1 :: -1][: len(data)]
    total = np.add.reduceat(weighted, begins) * inverse_powers(len(data) - ends)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return _symbols[(total >> np.uint64(58)).astype(np.int64)].tobytes().decode()


_inverse = [np.ones(1, np.uint64)]


def inverse_powers(exponents: np.ndarray) -> np.ndarray:
    """Inverses of powers of _PRIME modulo 2 ** 64 (the prime is odd, so they exist)."""
    n = int(exponents.max(initial=0)) + 1
    if len(_inverse[0]) < n:
        got = np.full(max(n, 1 << 16), np.uint64(pow(int(_PRIME), -1, 1 << 64)), np.uint64)
        got[0] = 1
        _inverse[0] = np.multiply.accumulate(got)
    return _inverse[0][exponents]


def fingerprint(text: str) -> str:
    """Fingerprint of the UTF-8 bytes of a text; ``0::`` for an empty one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "0::"
    zeros = zero_bits(data)
    level = max(0, (len(data) // (SIGNATURE * LONGEST)).bit_length() - 1)
    while len(ends := boundaries(zeros, level)) > SIGNATURE:
        level += 1
    return f"{level}:{signature(data, ends)}:{signature(data, boundaries(zeros, level + 1))}"


def likeness_of(first: list[str], second: list[str]) -> np.ndarray:
    """1 less the edit distance over the sum of both lengths, for pairs of signatures."""
    n = len(first)
    if not n:
        return np.zeros(0)
    sizes = [np.array([len(s) for s in side], np.int64) for side in (first, second)]
    spread = []
    for side, size in zip((first, second), sizes):
        flat = _place[np.frombuffer("".join(side).encode(), np.uint8)]
        grid = np.full((n, SIGNATURE), -1, np.int64)
        grid[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        spread.append(grid)
    rows = np.arange(n)
    match = np.zeros((n, 65), np.uint64)  # column 64 stands for no character
    for i in range(int(sizes[0].max())):
        at = spread[0][:, i]
        match[rows, np.where(at < 0, 64, at)] |= np.where(at < 0, np.uint64(0), np.uint64(1) << np.uint64(i))
    state = np.full(n, ~np.uint64(0))
    for j in range(int(sizes[1].max())):
        at = spread[1][:, j]
        hit = np.where(at < 0, np.uint64(0), match[rows, np.where(at < 0, 64, at)])
        state = (state + (state & hit)) | (state & ~hit)
    used = np.where(sizes[0] == 64, ~np.uint64(0), (np.uint64(1) << (sizes[0] % 64).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~state & used).astype(np.int64)
    total = sizes[0] + sizes[1]
    out = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
    for i in np.flatnonzero((out > 0) & (out < 1)).tolist():
        a, b = first[i], second[i]
        run = min(COMMON_RUN, len(a), len(b))
        grams = {a[k : k + run] for k in range(len(a) - run + 1)}
        if not any(b[k : k + run] in grams for k in range(len(b) - run + 1)):
            out[i] = 0.0
    return out


def compare_all(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1; 0 where they share no level."""
    out = np.zeros(len(first))
    where, a, b = [], [], []
    for i, (f, s) in enumerate(zip(first, second)):
        if f == s:
            out[i] = 1.0
            continue
        la, a1, a2 = f.split(":")
        lb, b1, b2 = s.split(":")
        if not a1 or not b1:
            continue
        step = int(lb) - int(la)
        for x, y in {0: ((a1, b1), (a2, b2)), 1: ((a2, b1),), -1: ((a1, b2),)}.get(step, ()):
            where.append(i)
            a.append(x)
            b.append(y)
    np.maximum.at(out, np.array(where, np.int64), likeness_of(a, b))
    return out


def fingerprints(text: Column) -> Column:
    """Fingerprint column of a text column; NULL counts as empty."""
    small_batches()

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for part in steps(texts) for t in part], pa.string())

    return of(text)


def likeness(first: Column, second: Column) -> Column:
    """Likeness of two fingerprint columns; NULL where one of them is NULL."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_pylist(), b.to_pylist()
        known = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
        out = [None] * len(x)
        for i, v in zip(known, compare_all([x[i] for i in known], [y[i] for i in known]).tolist()):
            out[i] = v
        return pa.array(out, pa.float64())

    return of(first, second)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ahead, key, doc_id, text) in order of id within partitions.

    A NULL id comes first, rows of the same id in the order of their texts. Each range ends with
    the first row of the next range that has rows, marked ``ahead``; the last with that of the
    first. The driver gets one id per range.
    """
    lowest = F.lit(-(1 << 63))
    docs = docs.select(
        F.coalesce("doc_id", lowest).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    parts = tasks(docs.sparkSession)
    bounds = id_bounds(docs, "key", parts)
    placed = docs.withColumn("bucket", range_of(F.col("key"), bounds))
    firsts = sorted((r["bucket"], r["k"]) for r in placed.groupBy("bucket").agg(F.min("key").alias("k")).collect())
    placed = placed.withColumn("ahead", F.lit(0))
    if firsts:
        to = F.create_map(*[F.lit(x) for (b, _), (_, k) in zip(firsts, firsts[1:] + firsts[:1]) for x in (k, b)])
        extra = docs.where(F.col("key").isin([k for _, k in firsts])).withColumn("bucket", to[F.col("key")])
        placed = placed.unionByName(extra.withColumn("ahead", F.lit(1)))
    return placed.repartitionById(max(parts, 1), "bucket").sortWithinPartitions("bucket", "ahead", "key", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, and fingerprints of the text, the edited and the next text."""
    small_batches()

    def walk(batches):
        held = None  # the document that waits for the next one
        closed = None  # the range whose end was reached
        for batch in batches:
            out = []
            at = 0
            for part in steps(batch.column(4)):
                rows = zip(*(batch.column(i).slice(at, len(part)).to_pylist() for i in (0, 1, 3)), part)
                at += len(part)
                for bucket, ahead, doc_id, text in rows:
                    if bucket == closed:
                        continue
                    own = fingerprint(text)
                    if held is not None:
                        out.append((*held, text, own))
                    held = (doc_id, text, own)
                    if ahead:
                        held, closed = None, bucket
                if out:
                    yield result(out)
                    out = []

    def result(rows):
        ids, texts, own, following, next_own = zip(*rows)
        edited = []
        for t, f in zip(texts, following):
            n = len(t) // 4
            edited.append(t[: len(t) - n] + f[:n] if n else t)
        changed = [o if e is t else fingerprint(e) for e, t, o in zip(edited, texts, own)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array(own, pa.string()),
                pa.array(changed, pa.string()),
                pa.array(compare_all(own, changed)),
                pa.array(compare_all(own, next_own)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return in_order(docs).select("bucket", "ahead", "key", "doc_id", "text").mapInArrow(
        walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return with_next(table(spark, sf_dir, "documents"))
