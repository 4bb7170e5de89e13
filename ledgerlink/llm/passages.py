"""Removal of passages that occur before, by sharded Aho-Corasick automata.

A window is WINDOW words in a row of one document. A word goes if a window that covers it also
starts earlier: in a document with a smaller id, or further ahead in the same one.

Whole copies of a document with a lower id are told by a digest of the text, and lose all words if
they have a window. For the other documents:

1. Each window has an anchor: the lowest hash among its runs of SEED words. Equal windows have equal
   anchors, and about every seventh word begins a new one. Anchors are counted over all documents,
   added up in each task first; those found more than once go into a filter of bounded size.
2. Documents with such an anchor are written once; the others are complete.
3. Their windows at such anchors are counted by hash, with the lowest document id, again added up in
   each task first, so that a passage of any frequency is one row per task. What occurs more than
   once is a confirmed passage; its words come from its first document.
4. Confirmed windows are the patterns of Aho-Corasick automata over words, sharded by anchor. The
   documents stream past them: the stretch of a document that has an anchor goes to the shard of that
   anchor. Frequent anchors are spread over several shards, with a copy of their patterns in each.
   An automaton compares words, not hashes, and finds every occurrence.
5. The places found come together per document, and the words go.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Filter, col, drop, fresh, small_batches, steps, table, tasks, written
from .words import Words, grams, sliding_min, split, word_hashes

WINDOW, SEED = 20, 8
#: Seeds in a window.
SEEDS = WINDOW - SEED + 1

_iter = re.compile(WORD).finditer
#: Patterns of one shard's automaton, about.
PATTERNS = 20_000


class Windows:
    """The windows of some texts with their anchors."""

    def __init__(self, texts: list[str]):
        self.words: Words = split(texts)
        hashes = word_hashes(self.words)
        many = len(hashes) - WINDOW + 1
        doc = self.words.doc
        self.at = np.flatnonzero(doc[:many] == doc[WINDOW - 1 :]) if many > 0 else np.zeros(0, np.int64)
        self.hashes = hashes
        self.seeds = grams(hashes, SEED)
        self.anchor = sliding_min(self.seeds, SEEDS)[self.at] if many > 0 else np.zeros(0, np.uint64)
        self.doc = doc[self.at]

    def places(self) -> np.ndarray:
        """The anchor at each place that is the anchor of some window."""
        if not len(self.at):
            return self.anchor
        over = np.zeros(len(self.seeds) + SEEDS - 1, np.uint64)
        over[self.at + SEEDS - 1] = self.anchor
        # No window has an anchor above its seeds: a seed is one if it reaches the highest of those
        # of the windows around it.
        return self.seeds[self.seeds == ~sliding_min(~over, SEEDS)]

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of chosen neighbours with one anchor."""
        place = np.flatnonzero(chosen)
        if not len(place):
            return place, place
        new = np.ones(len(place), bool)
        new[1:] = (
            (np.diff(place) > 1)
            | (self.anchor[place[1:]] != self.anchor[place[:-1]])
            | (self.doc[place[1:]] != self.doc[place[:-1]])
            | (np.diff(self.at[place]) > 1)
        )
        first = np.flatnonzero(new)
        return place[first], np.diff(np.append(first, len(place)))


def anchor_counts(docs: DataFrame, twice: Copies) -> DataFrame:
    """Places of each anchor that is found more than once: (anchor, n).

    ``docs`` has a text and the hash ``h`` of its row; whole copies don't count.
    """

    def count(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed():
            values, where = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return values, np.bincount(where, weights=np.concatenate([n for _, n in kept])).astype(np.int64)

        for batch in batches:
            own = batch.column(0).filter(pa.array(~twice.has(hashes_of(batch.column(1)))))
            for part in steps(own):
                values, n = np.unique(Windows(part).places(), return_counts=True)
                kept.append((values, n))
                held += len(values)
            if held > 1_000_000:
                values, n = summed()
                yield rows(values, n)
                kept, held = [], 0
        if held:
            yield rows(*summed())

    def rows(values, n):
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    counts = docs.select("text", "h").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where("n > 1")


def hashes_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


#: What ``mark`` tells of a text: it keeps all words, may lose some, or is a whole copy and loses all.
CLEAN, AFFECTED, COPY = 0, 1, 2


def mark(text, h, twice: Copies, known: Filter):
    """``struct<state, n_words, digest>`` of a text and the hash of its row.

    AFFECTED is a text with a window at a known anchor. ``digest`` is that of the words that stay,
    joined by one space; an AFFECTED text has none as yet.
    """

    @F.arrow_udf("struct<state: int, n_words: long, digest: string>")
    def of(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        state = np.where(twice.has(hashes_of(hashes)), COPY, CLEAN).astype(np.int32)
        n = np.zeros(len(state), np.int64)
        digests: list[str | None] = []
        at = 0
        for part in steps(texts):
            own, many = state[at : at + len(part)], n[at : at + len(part)]
            w = Windows(part)
            many[:] = np.diff(w.words.first)
            own[many < WINDOW] = CLEAN
            hit = w.doc[known.has(w.anchor)]
            own[hit[own[hit] == CLEAN]] = AFFECTED
            digests += [digest_of(t, o) for t, o in zip(part, own.tolist())]
            at += len(part)
        return pa.StructArray.from_arrays([pa.array(state), pa.array(n), pa.array(digests, pa.string())], ["state", "n_words", "digest"])

    def digest_of(text, state):
        if state == AFFECTED:
            return None
        return hashlib.sha256(b" ".join(words_of(text)) if state == CLEAN else b"").hexdigest()

    return of(text, h)


def words_of(text: str) -> list[bytes]:
    """Words of a text; bytes are split at the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def recurring(affected: DataFrame, known: Filter) -> DataFrame:
    """Hash and first document of each window that occurs more than once: (window, first)."""

    def emit(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                ids = batch.column(0).slice(at, len(part)).to_numpy()
                at += len(part)
                w = Windows(part)
                place = np.flatnonzero(known.has(w.anchor))
                hashes = grams(w.hashes, WINDOW)[w.at[place]] if len(place) else np.zeros(0, np.uint64)
                doc = ids[w.doc[place]]
                # The lowest document first, then one row per window with the number of its places.
                by = np.lexsort((doc, hashes))
                new = np.ones(len(by), bool)
                new[1:] = hashes[by[1:]] != hashes[by[:-1]]
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[by[first]].view(np.int64)),
                        pa.array(doc[by[first]]),
                        pa.array(np.diff(np.append(first, len(by))).astype(np.int32)),
                    ],
                    names=["window", "d", "n"],
                )

    rows = affected.select("d", "text").mapInArrow(emit, "window long, d long, n int")
    return rows.groupBy("window").agg(F.min("d").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")


SNIPPETS = "anchor long, d long, key long, start int, words string"


def patterns(affected: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Words of the confirmed windows, from their first documents, in runs of one anchor."""

    def emit(batches):
        for batch in batches:
            wanted = batch.column(2)
            at = 0
            for part in steps(batch.column(1)):
                for text, d, hashes in zip(part, batch.column(0).slice(at, len(part)).to_pylist(), wanted.slice(at, len(part))):
                    yield from of_document(text, d, hashes.values.to_numpy().view(np.uint64))
                at += len(part)

    def of_document(text, d, hashes):
        w = Windows([text])
        own = grams(w.hashes, WINDOW)[w.at] if len(w.at) else np.zeros(0, np.uint64)
        chosen = np.isin(own, hashes)
        # Of equal windows in the document the first is the pattern.
        _, first = np.unique(own, return_index=True)
        once = np.zeros(len(own), bool)
        once[first] = True
        begins, sizes = w.runs(chosen & once)
        if len(begins):
            yield snippets(w, begins, sizes, [d], [0], [text])

    firsts = confirmed.groupBy("first").agg(F.collect_list("window").alias("windows"))
    rows = affected.select("d", "text").join(firsts, F.col("d") == F.col("first")).select("d", "text", "windows")
    return rows.mapInArrow(emit, SNIPPETS)


def snippets(w: Windows, begins: np.ndarray, sizes: np.ndarray, ids: list[int], keys: list[int], part: list[str]) -> pa.RecordBatch:
    """Rows of SNIPPETS for runs of windows."""
    docs = w.doc[begins]
    words, held = [], -1
    out = []
    for doc, at, n in zip(docs.tolist(), w.at[begins].tolist(), sizes.tolist()):
        if doc != held:
            words, held = words_of(part[doc]), doc
        begin = at - int(w.words.first[doc])
        out.append(b" ".join(words[begin : begin + n + WINDOW - 1]).decode("utf-8", "surrogatepass"))
    starts = w.at[begins] - w.words.first[docs]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(w.anchor[begins].view(np.int64)),
            pa.array([ids[i] for i in docs.tolist()], pa.int64()),
            pa.array([keys[i] for i in docs.tolist()], pa.int64()),
            pa.array(starts, pa.int32()),
            pa.array(out, pa.string()),
        ],
        names=["anchor", "d", "key", "start", "words"],
    )


def stretches(affected: DataFrame, known: Filter) -> DataFrame:
    """The stretches of documents that have a known anchor."""

    def emit(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(2)):
                rows = batch.slice(at, len(part))
                at += len(part)
                w = Windows(part)
                begins, sizes = w.runs(known.has(w.anchor))
                yield snippets(w, begins, sizes, rows.column(0).to_pylist(), rows.column(1).to_pylist(), part)

    return affected.select("d", "key", "text").mapInArrow(emit, SNIPPETS)


#: A word is two letters of the automaton, so that no node has more than LETTERS or so children.
LETTERS = 256
#: Stretches whose hits a task remembers: copies have the same ones.
REMEMBERED = 20_000


class Codes(dict):
    """Letters of the words of patterns; other words have letters that no pattern has."""

    def __missing__(self, word):
        return (0, 0)


def occurrences(batches):
    """Rows of one shard, patterns first, to places (d, key, begin, end) of words to remove.

    Of equal patterns the one that comes last counts.
    """
    import ahocorasick

    codes = Codes()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    origin: list[tuple[int, int]] = []
    hits: dict[str, list[tuple[int, tuple[int, int]]]] = {}
    ready = False

    def letters(words: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(codes.__getitem__, words.split(" "))))

    def of_stretch(words: str) -> list[tuple[int, tuple[int, int]]]:
        """First word and origin of each pattern in a stretch."""
        if words not in hits:
            if len(hits) >= REMEMBERED:
                hits.clear()
            hits[words] = [(last // 2 - WINDOW + 1, origin[which]) for last, which in automaton.iter(letters(words))]
        return hits[words]

    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for kind, d, key, start, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if kind == 0:
                for w in words.split(" "):
                    if w not in codes:
                        codes[w] = (2 * (1 + len(codes) // LETTERS), 2 * (len(codes) % LETTERS) + 1)
                coded = letters(words)
                for k in range(len(coded) // 2 - WINDOW + 1):
                    automaton.add_word(coded[2 * k : 2 * (k + WINDOW)], len(origin))
                    origin.append((d, start + k))
                continue
            if not origin:
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            begin = end = -1
            for nth, first in of_stretch(words):
                place = start + nth
                if first < (d, place):
                    if place > end:
                        if end >= 0:
                            out.append((d, key, begin, end))
                        begin = place
                    end = place + WINDOW
            if end >= 0:
                out.append((d, key, begin, end))
        if out:
            a, b, c, e = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(e, pa.int32())],
                names=["d", "key", "begin", "end"],
            )


def locate(shards: DataFrame) -> DataFrame:
    """Places of words to remove; each partition has its patterns first, the lowest place of each last."""
    rows = shards.select("kind", "d", "key", "start", "words")
    return rows.mapInArrow(occurrences, "d long, key long, begin int, end int")


class Copies:
    """Rows whose whole text a document with a lower id has, too.

    One filter of bounded size names the copies, and in error some other rows; a second one names
    those others, and in error a few copies. Rows that the first names and the second does not are
    copies for certain; a copy that this leaves out is treated like any other document.
    """

    def __init__(self, keyed: DataFrame, d: str, key: str):
        rows = written(keyed.select(F.col(d).alias("d"), F.xxhash64(d, key).alias("h"), F.md5(col(keyed, "text").cast("binary")).alias("digest")))
        low = written(rows.groupBy("digest").agg(F.min("d").alias("low"), F.count("*").alias("m")).where("m > 1"))
        later = rows.join(low.select(F.col("digest").alias("same"), "low"), F.col("digest") == F.col("same")).where("d > low")
        later = written(later.select("h").distinct())
        self.named = Filter(later, "h")
        doubtful = rows.select("h").where(self.named.may_have(F.col("h"))).distinct()
        self.spared = Filter(doubtful.join(later.select(F.col("h").alias("of")), F.col("h") == F.col("of"), "left_anti"), "h")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For hashes of rows, whether they are copies; for use in tasks."""
        return self.named.has(hashes) & ~self.spared.has(hashes)


def find(docs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents whose words are settled, and those that may lose some.

    All have the columns of ``docs``. The first has also ``state`` (CLEAN or COPY), ``n_words`` and
    ``digest`` (the SHA-256 of the words that stay, joined by one space); the second ``spans``, an
    array of (begin, end) in words, which may touch or overlap, or be NULL. ``columns`` of the first
    are written with the second and the others are NULL; without ``columns`` reading the first costs
    another pass over the texts. Rows with the same id count as one document. A NULL id counts as
    the lowest, a NULL text as empty; equal rows stay equal rows.
    """
    small_batches()
    spark = docs.sparkSession
    d, key, hit = fresh(docs, "d", "key", "hit")
    keyed = docs.withColumns(
        {
            d: F.coalesce(col(docs, "doc_id"), F.lit(-(1 << 63))),
            key: F.xxhash64(col(docs, "doc_id"), col(docs, "text")),
        }
    )
    hashed = F.xxhash64(d, key)
    twice = Copies(keyed, d, key)
    anchors = written(anchor_counts(keyed.select(col(keyed, "text").alias("text"), hashed.alias("h")), twice))
    known = Filter(anchors, "anchor")
    marked = keyed.withColumn(hit, mark(col(keyed, "text"), hashed, twice, known))
    state = F.col(hit)["state"]
    if columns is None:
        kept = written(marked.where(state == AFFECTED).drop(hit))
        settled = marked.where(state != AFFECTED)
    else:
        # One pass: of settled rows only what is asked for, of affected ones all.
        lean = [F.when(state == AFFECTED, col(marked, c)).alias(c) if c not in columns else col(marked, c) for c in docs.columns]
        both = written(marked.select(*lean, d, key, hit, (state == AFFECTED).alias("affected")), ["affected"])
        kept = both.where("affected").drop(hit, "affected")
        settled = both.where("not affected")
    settled = settled.select(*[col(settled, c) for c in docs.columns], F.col(f"{hit}.*"))
    affected = kept.select(F.col(d).alias("d"), F.col(key).alias("key"), col(kept, "text").alias("text"))
    confirmed = written(recurring(affected, known))
    pattern = written(patterns(affected, confirmed))
    parts = max(tasks(spark), confirmed.count() // PATTERNS + 1)
    drop(confirmed)
    shards = dealt(pattern, stretches(affected, known), anchors, parts)
    spans = locate(shards).groupBy("d", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    s_d, s_key, s_spans = fresh(kept, "span_d", "span_key", "spans")
    spans = spans.select(F.col("d").alias(s_d), F.col("key").alias(s_key), F.col("spans").alias(s_spans))
    found = kept.join(spans, (kept[d] == spans[s_d]) & (kept[key] == spans[s_key]), "left")
    return settled, found.select(*[col(found, c) for c in docs.columns], F.col(s_spans).alias("spans"))


def dealt(pattern: DataFrame, stretch: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """Patterns and stretches by anchor, the patterns first in each partition.

    An anchor with more places than a tenth of a partition's mean share is spread: its stretches over
    several partitions, its patterns to each of them. There are at most ten times as many of those
    anchors as partitions, so their table is of bounded size.
    """
    total = anchors.agg(F.sum("n")).first()[0] or 0
    share = max(total // (10 * parts), 16)
    ways = F.broadcast(
        anchors.where(F.col("n") > share).select(F.col("anchor").alias("of"), F.least(F.lit(parts), (F.col("n") / share).cast("int") + 1).alias("ways"))
    )
    spread = F.coalesce("ways", F.lit(1))
    columns = ["d", "key", "start", "words"]
    left = pattern.join(ways, pattern["anchor"] == ways["of"], "left")
    left = left.select("anchor", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), F.lit(0).alias("kind"), *columns)
    right = stretch.join(ways, stretch["anchor"] == ways["of"], "left")
    right = right.select("anchor", F.pmod(F.xxhash64("key", "start"), spread).cast("int").alias("salt"), F.lit(1).alias("kind"), *columns)
    return left.unionByName(right).repartition(parts, "anchor", "salt").sortWithinPartitions("kind", F.desc("d"), F.desc("start"))


def covered(n: int, spans) -> np.ndarray:
    """Which of n words the spans cover."""
    step = np.zeros(n + 1, np.int64)
    for s in spans or ():
        step[s["begin"]] += 1
        step[s["end"]] -= 1
    return np.cumsum(step[:n]) > 0


def kept_words(text: str, spans) -> tuple[list[bytes], int]:
    """Words that stay, and the number of those that go."""
    words = words_of(text)
    gone = covered(len(words), spans)
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def cut(text: str, spans) -> str:
    """The text without the covered words; the white space after a word goes with it."""
    places = [m.span() for m in _iter(text)]
    gone = covered(len(places), spans).tolist()
    out, at = [], 0
    for i, (begin, _) in enumerate(places):
        if gone[i]:
            out.append(text[at:begin])
            at = places[i + 1][0] if i + 1 < len(places) else len(text)
    out.append(text[at:])
    return "".join(out)


def digests(found: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the digest of the others joined by one space."""

    def emit(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                places = batch.column(2).slice(at, len(part)).to_pylist()
                at += len(part)
                n, gone, digest = [], [], []
                for text, s in zip(part, places):
                    words, removed = kept_words(text, s)
                    n.append(len(words) + removed)
                    gone.append(removed)
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return found.select("doc_id", "text", "spans").mapInArrow(
        emit, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that occur before."""
    settled, found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    removed = F.when(F.col("state") == COPY, F.col("n_words")).otherwise(0).cast("long")
    settled = settled.select("doc_id", "n_words", removed.alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return settled.unionByName(digests(found))


#: The same in SQL: windows as texts, numbered by place.
OP9_SQL = r"""
with split as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents
), windows as (
    select doc_id, p, array_to_string(words[p : p + 19], ' ') as w
    from (select doc_id, words, unnest(range(1, len(words) - 18)) as p from split where len(words) >= 20)
), later as (
    select doc_id, p from (select doc_id, p, row_number() over (partition by w order by doc_id, p) as nth from windows) where nth > 1
), gone as (
    select distinct doc_id, q from (select doc_id, unnest(range(p, p + 20)) as q from later)
), placed as (
    select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as q from split
), marked as (
    select p.doc_id, p.word, p.q, g.q is not null as removed from placed p left join gone g on g.doc_id = p.doc_id and g.q = p.q
), summed as (
    select doc_id, count(*) as n_words, count(*) filter (removed) as n_removed,
           coalesce(string_agg(word, ' ' order by q) filter (not removed), '') as kept
    from marked group by doc_id
)
select s.doc_id, coalesce(m.n_words, 0)::bigint as n_words, coalesce(m.n_removed, 0)::bigint as n_removed,
       sha256(coalesce(m.kept, '')) as kept_sha256
from split s left join summed m using (doc_id)
"""


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the words of passages that occur before.

    Texts that keep all words stay as they are. A changed text gets its length in ``n_chars``, where
    that column exists; a document of which nothing is left goes.

    A text is cut once, by one worker of a task: the optimizer would repeat a deterministic function for
    the filter on its result, in a second worker that stays as long as the executor is busy.
    """

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if not s or t is None else cut(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    shortened = shortened.asNondeterministic()
    settled, found = find(docs)
    clean = settled.where(F.col("state") == CLEAN).select(*[col(settled, c) for c in docs.columns])
    changed = F.size(F.coalesce("spans", F.array())) > 0
    out = found.withColumn("text", shortened(F.col("text"), F.col("spans")))
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.unionByName(out.select(*docs.columns))
