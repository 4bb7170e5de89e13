"""Token ids of documents, packed with a length-limited canonical Huffman code.

Writing takes three passes over ever smaller data:

1. The documents go to ranges of their id and are tokenized in ascending order of it. The ids are
   written as a table, with the running number of ids within the range.
2. Counts per id are added up over all tasks; the driver gets at most one row per vocabulary entry
   and computes code lengths by package-merge. A canonical code needs only the lengths.
3. Each task packs its rows into segments of whole documents, and writes them.

The file format is Parquet with one row per segment: ``start`` (ids before the segment, over all
documents), ``n_tokens``, ``bits`` (the packed codes, as big-endian 32-bit words), ``checkpoints``
(bit offset of each block of ``block`` ids), ``doc_ids`` and ``doc_tokens``; and a table ``code``
with the code length of each id. Blocks are independent: a reader may begin at any checkpoint. The
decoder looks up the next LIMIT bits in one table and decodes all blocks of a segment side by side.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, folder, id_bounds, range_of, small_batches, steps, table, tasks, written

#: Longest code in bits; the decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Ids of a segment: it ends with the document that reaches this number.
SEGMENT = 1 << 18
#: Ids between two checkpoints.
BLOCK = 512

#: Words that a worker remembers (about 200 bytes each), and the longest one, in bytes.
CACHE_WORDS = 1_500_000
CACHE_LENGTH = 48

#: Words that the library encodes as one text, and what stands between them: a control character.
JOINED = 500
MARK = b"\x01"
SEPARATOR = b" " + MARK + b" "
#: Kinds of bytes: white space, ASCII letters, ASCII signs but apostrophes, all others. The two bytes of a Latin-1
#: letter are letters as well; LATIN is the first one.
BLANK, LETTER, SIGN, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = BLANK
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = SIGN
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32
LATIN = 0xC3
#: Either part of a word of letters with signs behind them, and how a vocabulary has to treat them to split there:
#: it lowers letters and never joins them with signs. END ends the last token of a part.
PART = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")
END = "</w>"
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

IDS_SCHEMA = "bucket int, before long, doc_id long, n_tokens long, ids binary"
SEGMENT_SCHEMA = (
    "start long, n_tokens long, bits binary, checkpoints array<long>, "
    "doc_ids array<long>, doc_tokens array<long>"
)


# --- the code -------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for a symbol that never occurs.

    Package-merge: in each of ``limit`` rounds, neighbours of the sorted list are paired and merged
    with the single symbols. A symbol's length is the number of rounds in which it is among the
    first 2n - 2 items, counted backwards through the rounds. One symbol alone has length 1.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.int64)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # is_single[r][i]: item i of round r is a symbol, not a pair of the round before.
    is_single, items = [np.ones(n, bool)], weight
    for _ in range(limit - 1):
        pairs = items[0 : len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        single = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        by = np.argsort(both, kind="stable")
        items = both[by]
        is_single.append(single[by])
    many = 2 * n - 2
    found = np.zeros(n, np.int64)
    for single in reversed(is_single):
        singles = int(single[:many].sum())
        found[:singles] += 1
        many = 2 * (many - singles)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order]
        # Each code takes 2 ** (longest - length) places of the longest length.
        longest = int(sizes[-1])
        places = np.left_shift(np.uint64(1), (longest - sizes).astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(places)[:-1]]).astype(np.uint64)
        codes[order] = first >> (longest - sizes).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next ``width`` bits."""
    width = int(lengths.max(initial=1))
    symbol = np.zeros(1 << width, np.int32)
    size = np.zeros(1 << width, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    many = np.left_shift(1, width - lengths[order])
    total = int(many.sum())
    symbol[:total] = np.repeat(order, many)
    size[:total] = np.repeat(lengths[order], many)
    return symbol, size, width


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Codes of the ids in a row, and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    ends = np.cumsum(size)
    begins = ends - size
    word = begins >> 5
    # A code lies in its word and perhaps the next one: 64 bits from the start of its word.
    at = codes[ids] << (64 - (begins & 31) - size).astype(np.uint64)
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    here = word[first]
    words[here] += np.add.reduceat(at >> np.uint64(32), first)
    words[here + 1] += np.add.reduceat(at & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), begins[::block]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, code: tuple, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, decoded side by side from their checkpoints."""
    symbol, size, width = code
    if not n:
        return np.zeros(0, np.int32)
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.array(checkpoints, np.int64)
    out = np.zeros((len(at), block), np.int32)
    shift = np.uint64(64 - width)
    full = len(at) if n % block == 0 else len(at) - 1
    for k in range(block):
        if k == n - (len(at) - 1) * block:
            at = at[:full]  # the last block is shorter
            if not full:
                break
        key = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
        out[: len(at), k] = symbol[key]
        at = at + size[key]
    return out.ravel()[:n]


# --- tokenizing -----------------------------------------------------------------------------


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class WordTokenizer:
    """Encodes words with the ``tokenizers`` library, each different word once while it is remembered.

    The vocabulary's pattern never crosses white space and its normalizer works on runs without
    it, so the ids of a text are those of its words in a row. New words go to the library JOINED at a
    time, with a word of MARK alone between them, whose id no word without that character has. Where the
    vocabulary lowers letters and splits them from signs, the two parts of a word of letters with signs behind
    them count as two words, in small letters, and go there without marks: the last token of a part, and no
    other, ends with END.

    Words are cut, told apart and replaced by their ids as arrays over all texts of a call; Python
    handles each different word of a call once. The ids of all remembered words lie in one array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Number of each word; its ids are ``ids[begin[number]:][:size[number]]``.
        self.known: dict[bytes, int] = {}
        self.many = self.filled = 0
        self.begin, self.size, self.ids = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.int32)
        mark = self.library.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        splits = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": LETTERS}, "Removed", True)
        self.lowers = splits and (made["normalizer"] or {}).get("normalizers") == LOWERED
        self.lowers = self.lowers and made["model"].get("end_of_word_suffix") == END
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True

    def learn(self, new: list[bytes]) -> None:
        """Encode words that are not known."""
        parts = [w for w in new if PART.fullmatch(w)] if self.lowers else []
        self.ask_parts(parts)
        self.ask(set(new).difference(parts))

    def keep(self, words: list[bytes], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Remember that the ids of each word are ``ids[begin:end]``."""
        many, filled = self.many, self.filled
        self.many, self.filled = many + len(words), filled + len(ids)
        self.begin, self.size, self.ids = grown(self.begin, self.many), grown(self.size, self.many), grown(self.ids, self.filled)
        self.begin[many : self.many] = filled + begins
        self.size[many : self.many] = ends - begins
        self.ids[filled : self.filled] = ids
        self.known.update(zip(words, range(many, self.many)))

    def ask_parts(self, words: list[bytes]) -> None:
        """Encode parts of words by the library."""
        alone = set()
        for at in range(0, len(words), 10 * JOINED):
            parts = [words[i : i + JOINED] for i in range(at, min(at + 10 * JOINED, len(words)), JOINED)]
            for part, ids in zip(parts, self.ids_of([b" ".join(part) for part in parts])):
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(part):
                    alone.update(part)
                    continue
                self.keep(part, ids, np.append(0, ends[:-1]), ends)
        self.ask(alone)

    def ask(self, new: set[bytes]) -> None:
        """Encode words by the library."""
        alone = [w for w in new if MARK in w] if self.mark is not None else list(new)
        words = list(new.difference(alone))
        for at in range(0, len(words), 10 * JOINED):
            parts = [words[i : i + JOINED] for i in range(at, min(at + 10 * JOINED, len(words)), JOINED)]
            for part, ids in zip(parts, self.ids_of([SEPARATOR.join(part) for part in parts])):
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                if len(ends) != len(part):  # a vocabulary that joins words
                    alone += part
                    continue
                self.keep(part, ids, np.append(0, ends[:-1] + 1), ends)
        for at in range(0, len(alone), 5000):
            part = alone[at : at + 5000]
            found = self.ids_of(part)
            ends = np.cumsum([len(ids) for ids in found])
            self.keep(part, np.concatenate(found), np.append(0, ends[:-1]), ends)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        coded = self.library.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in coded]

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, with the end id."""
        gc.disable()  # nothing here makes cycles, and walking all words again and again takes long
        try:
            return self.coded(texts, end)
        finally:
            gc.enable()

    def words(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Words of some texts: the different one that each is, these, and where the words of each text end."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
        kind, small = KINDS[data], SMALL[data]
        if not self.lowers:
            kind[kind != BLANK] = OTHER
        else:
            lead = np.flatnonzero(data == LATIN)
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
            kind[lead] = kind[lead + 1] = LETTER
            small[lead[data[lead + 1] < 0x9F] + 1] += 32
        # Where the kind changes: words begin and end, or letters give way to signs.
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        now, was = kind[change], kind[change - 1]
        opens, closes = was == BLANK, now == BLANK
        begin, end = change[opens], change[closes]
        word = np.cumsum(opens) - 1
        # A word of other bytes, or with signs before letters or alone, stays whole and unchanged.
        whole = np.zeros(len(begin), bool)
        whole[word[(now == OTHER) | (now == SIGN) & opens | (now == LETTER) & (was == SIGN)]] = True
        cut = (now == SIGN) & (was == LETTER) & ~whole[word]
        begins, sizes = change[opens | cut], change[closes | cut] - change[opens | cut]
        begin, size = begin[whole], (end - begin)[whole]
        same = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        small[same] = data[same]
        offsets = np.zeros(len(begins) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        solid = np.ascontiguousarray(small[kind != BLANK])
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        stops = np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)
        return found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(begins, stops)

    def coded(self, texts: list[str], end: int) -> list[bytes]:
        nth, words, stops = self.words(texts)
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.many = self.filled = 0
            new = np.arange(len(words))
        missing = [words[i] for i in new.tolist()]
        long = [w for w in missing if len(w) > CACHE_LENGTH]
        self.learn([w for w in missing if len(w) <= CACHE_LENGTH] if long else missing)
        many, filled = self.many, self.filled
        self.learn(long)
        number[new] = [self.known[w] for w in missing]
        # The end id stands behind the last word of each text.
        number = number[nth]
        size = np.insert(self.size[number], stops, 1)
        ends = np.cumsum(size)
        begins = np.insert(self.begin[number], stops, 0)
        ids = self.ids[np.repeat(begins - (ends - size), size) + np.arange(size.sum())]
        ends = ends[stops + np.arange(len(stops))]
        ids[ends - 1] = end
        blob, ends = ids.tobytes(), (4 * ends).tolist()
        if long:
            self.many, self.filled = many, filled
            for w in long:
                del self.known[w]
        return [blob[a:b] for a, b in zip([0, *ends], ends)]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# --- the format -----------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, make: Callable = word_tokenizer) -> None:
    """Write the ids of ``docs`` (columns doc_id, text) in ascending order of doc_id to ``path``.

    A NULL text counts as empty and has the end id alone. A NULL doc_id comes first; rows of the
    same doc_id follow in the order of their texts, repeated rows stay. No rows give no segments.
    """
    small_batches()
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = tasks(spark)
    bounds = id_bounds(docs, "doc_id", parts)

    def tokenize(batches):
        before: dict[int, int] = {}
        for batch in batches:
            at = 0
            for part in steps(batch.column(2), 2_000_000):
                rows = batch.slice(at, len(part))
                at += len(part)
                coded = make(tokenizer).encode(part, end)
                buckets = rows.column(0).to_pylist()
                n, starts = [len(c) // 4 for c in coded], []
                for b, k in zip(buckets, n):
                    starts.append(before.get(b, 0))
                    before[b] = starts[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(buckets, pa.int32()),
                        pa.array(starts, pa.int64()),
                        rows.column(1),
                        pa.array(n, pa.int64()),
                        pa.array(coded, pa.binary()),
                    ],
                    names=["bucket", "before", "doc_id", "n_tokens", "ids"],
                )

    ordered = (
        docs.select(range_of(F.col("doc_id"), bounds).alias("bucket"), "doc_id", "text")
        .repartitionById(max(parts, 1), "bucket")
        .sortWithinPartitions("bucket", "doc_id", "text")
    )
    ids = written(ordered.mapInArrow(tokenize, IDS_SCHEMA))

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32))
            if len(more) > len(total):
                total, more = more.astype(np.int64), total
            total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    used = counts["id"].to_numpy()
    total = np.zeros(used.max(initial=-1) + 1, np.int64)
    total[used] = counts["n"].to_numpy()
    lengths = code_lengths(total)
    codes = canonical(lengths)
    sizes = {r["bucket"]: r["n"] for r in ids.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    base, so_far = {}, 0
    for b in sorted(sizes):
        base[b] = so_far
        so_far += sizes[b]

    def segments(batches):
        held, held_ids, n, start = [], [], 0, 0

        def close():
            values = np.concatenate(held)
            bits, checkpoints = pack(values, lengths, codes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([start], pa.int64()),
                    pa.array([len(values)], pa.int64()),
                    pa.array([bits], pa.binary()),
                    pa.array([checkpoints.tolist()], pa.list_(pa.int64())),
                    pa.array([held_ids], pa.list_(pa.int64())),
                    pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                ],
                names=["start", "n_tokens", "bits", "checkpoints", "doc_ids", "doc_tokens"],
            )

        for batch in batches:
            for b, before, doc_id, blob in zip(*(batch.column(i) for i in range(4))):
                place = base[b.as_py()] + before.as_py()
                if held and (n >= SEGMENT or place != start + n):
                    yield close()
                    held, held_ids, n = [], [], 0
                if not held:
                    start = place
                held.append(np.frombuffer(blob.as_buffer(), np.int32))
                held_ids.append(doc_id.as_py())
                n += len(held[-1])
        if held:
            yield close()

    ids.select("bucket", "before", "doc_id", "ids").mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(f"{path}/segments")
    spark.createDataFrame([(lengths.astype(np.uint8).tobytes(),)], "lengths binary").write.parquet(f"{path}/code")
    drop(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder: start, doc_id, n_tokens, ids (little-endian 32-bit integers)."""
    small_batches()
    lengths = spark.read.schema("lengths binary").parquet(f"{path}/code").collect()[0]["lengths"]
    lengths = np.frombuffer(bytes(lengths), np.uint8).astype(np.int64)

    def documents(batches):
        code = decoding_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, bits, checkpoints, doc_ids, sizes = (batch.column(i)[row] for i in range(6))
                ids = unpack(bits.as_buffer(), checkpoints.values.to_numpy(), n.as_py(), code)
                sizes = sizes.values.to_numpy()
                stops = np.cumsum(sizes)
                begins = stops - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(begins + start.as_py(), pa.int64()),
                        doc_ids.values,
                        pa.array(sizes, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(begins.tolist(), stops.tolist())], pa.binary()),
                    ],
                    names=["start", "doc_id", "n_tokens", "ids"],
                )

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    return segments.mapInArrow(documents, "start long, doc_id long, n_tokens long, ids binary")


def op1_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written with the code and read back from the files."""
    import public_tokenizers as vocabularies

    path = folder(spark)
    write(table(spark, sf_dir, "documents"), path, vocabularies.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
