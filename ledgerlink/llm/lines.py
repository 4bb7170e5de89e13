"""Quality rules by line labels of a linear-chain conditional random field.

Each line with a word is content or boilerplate. A line's features (shares of character classes,
repeated words, length, whether it repeats an earlier line) weigh for content; transition weights
tie neighbouring lines together; Viterbi decoding finds the best labels of a whole document. A
document is kept if it passes the base rules and the content lines hold enough of its words.

The field learns from document labels by one turn of expectation maximization with hard line labels.
Scores of single lines are fitted on the labels of their documents. They give the best labels of every
line under its document's label: content lines hold enough of the words of a good document, and not
of a bad one. Then the likelihood of these label sequences, which change within documents, is maximized
with forward-backward sums. There is one turn since each further one takes fewer changes for granted,
until every document has one label. All that is on a bounded sample. Marking reads every text once,
where it lies, with all of its lines.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, steps, table
from .words import Words, repeated_windows, split

#: Labelled documents that the field is fitted on at most, and the lines that each gives at most.
SAMPLE, SAMPLE_LINES = 3000, 400
#: Share of words in content lines from which a document is kept.
CONTENT = 0.5
#: Fewer words, or a larger percentage of words in repeated windows, fail a document.
LEAST_WORDS, MOST_REPEATED = 50, 50
ROUNDS, RATE, DECAY = 150, 0.1, 1e-3
#: Steps to the bias of a document.
HALVINGS = 12

SYMBOLS = b"#*$%&|<>"
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper, _lower, _digit = (np.array([f(chr(b)) and b < 128 for b in range(256)]) for f in (str.isupper, str.islower, str.isdigit))
_stop = np.zeros(256, bool)
_stop[list(b".!?:;\"')")] = True

FEATURES = 11


@dataclass(frozen=True)
class Lines:
    """Lines with a word of some texts, and the counts of the texts."""

    x: np.ndarray  # features
    n_words: np.ndarray  # words of each line
    first: np.ndarray  # first line of each text, and the end of the last
    place: np.ndarray  # number of each line among all lines of its text
    counts: dict[str, np.ndarray]  # per text


def repeats(texts: list[str]) -> list[np.ndarray]:
    """For each text, which lines equal an earlier line."""
    out = []
    for t in texts:
        seen: set[str] = set()
        lines = t.split("\n")
        again = np.zeros(len(lines), bool)
        for i, line in enumerate(lines):
            if line in seen:
                again[i] = True
            else:
                seen.add(line)
        out.append(again)
    return out


def measure(texts: list[str]) -> Lines:
    """Features of lines and counts of texts."""
    w: Words = split(texts)
    n = len(texts)
    again = repeats(texts)
    many = np.array([len(a) for a in again], np.int64)
    before = np.concatenate([[0], np.cumsum(many)])
    total = int(before[-1])
    of_text = np.repeat(np.arange(n), np.diff(w.starts))
    breaks = w.data == 10
    # A line break belongs to the line that it ends; each text begins a line of its own.
    line = np.cumsum(breaks) - breaks + of_text
    of_word = line[w.begin]
    words = np.bincount(of_word, minlength=total)
    covered = repeated_windows(w, 3)
    chars = np.bincount(line, weights=(w.data & 0xC0) != 0x80, minlength=total)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=total) / np.maximum(chars, 1)

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=values, minlength=total) / np.maximum(words, 1)

    repeated = np.concatenate(again) if again else np.zeros(0, bool)
    x = np.zeros((total, FEATURES))
    symbols = _symbol[w.data]
    ends = w.data[w.begin + w.size - 1] if len(w.begin) else np.zeros(0, np.uint8)
    x[:, 0] = 1
    x[:, 1] = share(symbols) * 5
    x[:, 2] = share(_upper[w.data]) * 3
    x[:, 3] = share(_digit[w.data]) * 3
    x[:, 4] = of_words(covered)
    x[:, 5] = repeated
    x[:, 6] = np.minimum(words, 40) / 20
    x[:, 7] = of_words(w.size) / 10
    x[:, 8] = of_words(_symbol[ends])
    x[:, 9] = of_words(ends == ord("!"))
    x[:, 10] = of_words(_stop[ends])
    full = np.flatnonzero(words)
    of_line = np.repeat(np.arange(n), many)
    of_doc = of_line[full]
    counts = {
        "n_words": np.diff(w.first),
        "word_chars": np.bincount(w.doc, weights=word_chars(w), minlength=n).astype(np.int64),
        "n_symbols": np.bincount(of_text[symbols], minlength=n),
        "n_dup_lines": np.bincount(of_doc[repeated[full]], minlength=n),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
    }
    return Lines(x[full], words[full], np.searchsorted(full, before), full - before[of_doc], counts)


def word_chars(w: Words) -> np.ndarray:
    """Code points of each word."""
    if not len(w.begin):
        return np.zeros(0)
    leads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    return leads[w.begin + w.size] - leads[w.begin]


@dataclass(frozen=True)
class Field:
    """Weights of a line's features for content, and of two labels in a row (0 boilerplate, 1 content)."""

    weight: np.ndarray
    step: np.ndarray

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most probable labels of the lines of each text; of two equally good ones, content."""
        return self.best(x @ self.weight, first)

    def best(self, gains: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same by what each line gains as content."""
        gain = gains.tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        out = np.zeros(len(gain), bool)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if a == b:
                continue
            off, on = 0.0, gain[a]
            came = []
            for g in gain[a + 1 : b]:
                to_off, to_on = on + s10 >= off + s00, on + s11 >= off + s01
                came.append((to_off, to_on))
                off, on = (on + s10 if to_off else off + s00), (on + s11 if to_on else off + s01) + g
            label = on >= off
            out[b - 1] = label
            for k in range(b - 2, a - 1, -1):
                label = came[k - a][label]
                out[k] = label
        return out


def expected(field: Field, gain: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: chance of content per line, and of label pairs in all."""
    n, longest = gain.shape
    ahead = np.zeros((n, longest, 2))
    back = np.zeros((n, longest, 2))
    ahead[:, 0, 1] = gain[:, 0]
    for t in range(1, longest):
        got = np.logaddexp(ahead[:, t - 1, :1] + field.step[0], ahead[:, t - 1, 1:] + field.step[1])
        got[:, 1] += gain[:, t]
        ahead[:, t] = np.where(real[:, t, None], got, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        later = back[:, t + 1].copy()
        later[:, 1] += gain[:, t + 1]
        got = np.logaddexp(field.step[:, 0] + later[:, :1], field.step[:, 1] + later[:, 1:])
        back[:, t] = np.where(real[:, t + 1, None], got, 0.0)
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    content = np.where(real, np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None]), 0.0)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            log = ahead[:, :-1, a] + field.step[a, b] + back[:, 1:, b] + (gain[:, 1:] if b else 0) - whole[:, None]
            pairs[a, b] = np.exp(np.where(real[:, 1:], log, -np.inf)).sum()
    return content, pairs


def line_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of single lines for the labels of their documents."""
    weight = np.zeros(FEATURES)
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    for t in range(1, ROUNDS + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ weight)) - y) / len(x) + DECAY * weight
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        weight = weight - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weight


def line_labels(field: Field, bags: list[np.ndarray], words: list[np.ndarray], labels: list[int]) -> list[np.ndarray]:
    """Best line labels of each document under its own label.

    Where the best labels of all contradict the document's label, a bias for each word, as small as
    halving finds it, turns the lines that are nearest to the other label.
    """
    out = []
    for x, w, y in zip(bags, words, labels):
        gain, first = x @ field.weight, np.array([0, len(x)])

        def agrees(got: np.ndarray) -> bool:
            return (w @ got >= CONTENT * w.sum()) == bool(y)

        got = field.best(gain, first)
        if not agrees(got):
            per_word = (1 if y else -1) * w / w.mean()
            # With this much every line has the document's label.
            low, high = 0.0, (np.abs(gain).max() + 2 * np.abs(field.step).max() + 1) * w.mean() / w.min()
            got = np.full(len(x), bool(y))
            for _ in range(HALVINGS):
                middle = (low + high) / 2
                tried = field.best(gain + middle * per_word, first)
                if agrees(tried):
                    got, high = tried, middle
                else:
                    low = middle
        out.append(got)
    return out


def maximize(batches: list[tuple[np.ndarray, np.ndarray]], seen_x: np.ndarray, seen_step: np.ndarray, lines: int) -> Field:
    """Field under which label sequences with these sums are most probable."""
    flat = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, ROUNDS + 1):
        field = Field(flat[:FEATURES], flat[FEATURES:].reshape(2, 2))
        got_x, got_step = np.zeros(FEATURES), np.zeros((2, 2))
        for x, real in batches:
            content, pairs = expected(field, x @ field.weight, real)
            got_x += np.einsum("ntf,nt->f", x, content)
            got_step += pairs
        g = np.concatenate([got_x - seen_x, (got_step - seen_step).ravel()]) / lines + DECAY * flat
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        flat = flat - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field(flat[:FEATURES], flat[FEATURES:].reshape(2, 2))


def fit(bags: list[np.ndarray], words: list[np.ndarray], labels: list[int]) -> Field:
    """Field for documents by features and words of their lines, and by their labels."""
    some = [i for i, b in enumerate(bags) if len(b)]
    bags, words, labels = [bags[i] for i in some], [words[i] for i in some], [int(bool(labels[i])) for i in some]
    weight = np.zeros(FEATURES)
    weight[0] = 1.0  # without labels every line is content
    if len(set(labels)) < 2:
        return Field(weight, np.zeros((2, 2)))
    # Sequences of like length are padded to the longest of their batch.
    order = np.argsort([len(b) for b in bags], kind="stable")
    batches = []
    for part in np.array_split(order, max(1, len(order) // 200)):
        longest = max(len(bags[i]) for i in part)
        x = np.zeros((len(part), longest, FEATURES))
        real = np.zeros((len(part), longest), bool)
        for row, i in enumerate(part):
            x[row, : len(bags[i])] = bags[i]
            real[row, : len(bags[i])] = True
        batches.append((x, real))
    lines = sum(len(b) for b in bags)
    field = Field(line_scores(np.concatenate(bags), np.repeat(labels, [len(b) for b in bags])), np.zeros((2, 2)))
    found = line_labels(field, bags, words, labels)
    seen_x = sum((b[y].sum(0) for b, y in zip(bags, found)), np.zeros(FEATURES))
    seen_step = np.zeros((2, 2))
    for y in found:
        np.add.at(seen_step, (y[:-1].astype(int), y[1:].astype(int)), 1)
    return maximize(batches, seen_x, seen_step, lines)


def run_of_lines(doc_id: int, begin: int, end: int, most: int = SAMPLE_LINES) -> slice:
    """All lines of a document, or ``most`` consecutive ones from a line drawn by its id."""
    room = end - begin - most
    if room <= 0:
        return slice(begin, end)
    start = begin + zlib.crc32(str(doc_id).encode()) % (room + 1)
    return slice(start, start + most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Field:
    """Fit on at most ``most`` labelled documents, drawn by a hash of the id.

    Of a document with more than SAMPLE_LINES lines a run of that many is used, which begins at a line
    drawn by the id. Rows with a NULL label or id are not used; of several labels of one document the
    lowest counts, of several texts the first in their order.
    """
    small_batches()
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit("lines"), F.col("doc_id")), "doc_id")
        .limit(most)
    )

    def describe(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(2)):
                got = measure(part)
                rows = batch.slice(at, len(part))
                at += len(part)
                ends = zip(rows.column(0).to_pylist(), got.first[:-1].tolist(), got.first[1:].tolist())
                runs = [run_of_lines(i, a, b) for i, a, b in ends]
                cut = [pa.array([v[r].tobytes() for r in runs], pa.binary()) for v in (got.x, got.n_words.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *cut], names=["doc_id", "label", "x", "words"])

    # At most `most` rows of two integers are broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = picked.mapInArrow(describe, "doc_id long, label int, x binary, words binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return fit(
        [np.frombuffer(bytes(r["x"]), np.float64).reshape(-1, FEATURES) for r in rows],
        [np.frombuffer(bytes(r["words"]), np.int64) for r in rows],
        [r["label"] for r in rows],
    )


def mark(text: Column, field: Field) -> Column:
    """Counts of a text, the labels of its lines with a word, and the share of words in content lines.

    ``lines`` numbers the \\n-split lines that have a word and ``content`` tells which are content;
    both are empty, and the share is 0, for NULL and texts without words.
    """
    small_batches()

    @F.arrow_udf(
        "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
        "content_share: double, lines: array<int>, content: array<boolean>>"
    )
    def of(texts: pa.Array) -> pa.Array:
        chunks = []
        for part in steps(texts):
            got = measure(part)
            label = field.decode(got.x, got.first)
            doc = np.repeat(np.arange(len(part)), np.diff(got.first))
            good = np.bincount(doc, weights=got.n_words * label, minlength=len(part))
            offsets = pa.array(got.first, pa.int32())
            fields = {k: pa.array(v, pa.int64()) for k, v in got.counts.items()}
            fields["content_share"] = pa.array(good / np.maximum(got.counts["n_words"], 1))
            fields["lines"] = pa.ListArray.from_arrays(offsets, pa.array(got.place, pa.int32()))
            fields["content"] = pa.ListArray.from_arrays(offsets, pa.array(label))
            chunks.append(pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        return pa.concat_arrays(chunks)

    return of(text)


def verdicts(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs``: its counts, the base rules and whether it is kept."""
    m = docs.select("doc_id", mark(docs["text"], field).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= CONTENT))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules for every document, by a field of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    field = train(docs, labels.where(~held_out(labels["doc_id"])))
    return verdicts(docs, field).drop("lines", "content")
