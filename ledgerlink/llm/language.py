"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of one to three characters per language over all labelled documents:
each task adds up a dense table per language and passes on one row per used cell, so the shuffle
carries at most languages x BUCKETS rows per task, and the driver as many in total, whatever the
number of documents. The matrix of log probabilities, of that same bounded size, goes to the
workers with the function; scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, held_out, small_batches, steps, table

#: Cells that n-grams are hashed to; a power of two.
BUCKETS = 1 << 14
#: Added to every count.
SMOOTHING = 0.5
#: Languages that a model may have; the matrix has as many columns.
MOST_LANGUAGES = 1000
#: Longest runs of characters that are looked at together.
ORDERS = (1, 2, 3)
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of some texts, row by row of characters, and the start of each text.

    Texts are lower-cased; whatever is no letter counts as one space, in runs too. The result has
    one row per character and one column per order; cell BUCKETS stands for no n-gram.
    """
    joined = "\0".join(t.lower() for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    ends = np.flatnonzero(points == 0)
    if len(ends) != len(texts):  # a text has the separator itself
        joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[points]
        ends = np.flatnonzero(points == 0)
    plain = np.where(is_letter, points, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of other characters
    keep[ends] = True
    keep[np.append(0, ends[:-1] + 1)] = True  # such a run may open a text
    plain = plain[keep]
    where = np.cumsum(keep)
    starts = np.concatenate([[0], where[ends[:-1]]]) if len(ends) else np.zeros(0, np.int64)
    letter = is_letter[keep]
    is_end = np.zeros(len(plain), bool)
    is_end[where[ends] - 1] = True
    out = np.full((len(plain), len(ORDERS)), BUCKETS, np.int32)
    mixed = np.zeros(len(plain), np.uint32)
    has_letter = np.zeros(len(plain), bool)
    over = np.zeros(len(plain), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(plain) - n + 1
        if m <= 0:
            break
        # An n-gram that begins at a character adds the character n - 1 places on.
        mixed[:m] = (mixed[:m] ^ plain[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
        if n > 1:  # it may take in the end of its text as its last character, and no more
            over[:m] |= is_end[n - 2 : n - 2 + m]
        has_letter[:m] |= letter[n - 1 :]
        if n in ORDERS:
            h = mixed[:m] * np.uint32(0x9E3779B1)
            cell = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
            good = has_letter[:m] & ~over[:m]
            out[:m, ORDERS.index(n)] = np.where(good, cell, BUCKETS)
    return out, starts


@dataclass(frozen=True)
class Model:
    """Languages in order and, per cell, the log probability in each; the last row is no n-gram."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all rows of ``docs`` with a language; rows with a NULL language are not counted.

    No labelled row gives a model without languages, which answers ``und`` for every text.
    """
    small_batches()

    def count(rows):
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in rows:
            langs = batch.column(1).to_pylist()
            at = 0
            for part in steps(batch.column(0)):
                found, starts = cells(part)
                stops = np.append(starts[1:], len(found))
                own = np.array(langs[at : at + len(part)])
                at += len(part)
                for name in np.unique(own):
                    here = np.repeat(own == name, stops - starts)
                    if name not in totals:
                        totals[name] = np.zeros(BUCKETS + 1, np.int64)
                        seen[name] = 0
                    totals[name] += np.bincount(found[here].ravel(), minlength=BUCKETS + 1)
                    seen[name] += int((own == name).sum())
        for name, t in totals.items():
            used = np.flatnonzero(t[:BUCKETS])
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * (len(used) + 1), pa.string()),
                    "cell": pa.array(np.append(used, -1), pa.int32()),
                    "n": pa.array(np.append(t[used], seen[name]), pa.int64()),
                }
            )

    labelled = docs.where(col(docs, lang).isNotNull()).select(col(docs, text), col(docs, lang))
    counts = labelled.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    languages = tuple(sorted(set(got["lang"].to_pylist())))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix holds {MOST_LANGUAGES}")
    n = np.zeros((BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    place = {name: i for i, name in enumerate(languages)}
    column = np.array([place[x] for x in got["lang"].to_pylist()], int)
    cell, value = got["cell"].to_numpy(), got["n"].to_numpy()
    n[cell[cell >= 0], column[cell >= 0]] = value[cell >= 0]
    prior[column[cell < 0]] = value[cell < 0]
    log_prob = np.log(n + SMOOTHING) - np.log(n.sum(0) + SMOOTHING * BUCKETS)
    log_prob = np.vstack([log_prob, np.zeros(len(languages))]).astype(np.float32)
    # Without languages the model is empty, and the sum is that of nothing.
    return Model(languages, log_prob, np.log(prior + 1) - np.log(max(prior.sum() + len(languages), 1)))


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language (-1 for none) and its posterior probability for each text."""
    found, starts = cells(texts)
    many = len(model.languages)
    total = np.zeros((len(texts), many))
    # The texts' used cells, with counts, times the matrix: a slice of one text's cells at a time
    # stays within the processor's cache.
    for order in range(found.shape[1]):
        for j in range(many):
            total[:, j] += np.add.reduceat(model.log_prob[:, j][found[:, order]], starts, dtype=np.float64)
    known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    if not many:
        return np.full(len(texts), -1), np.zeros(len(texts))
    total += model.log_prior
    best = total.argmax(1)
    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return np.where(known, best, -1), np.where(known, share, 0.0)


def predict(text: Column, model: Model) -> Column:
    """``struct<lang, score>`` of a text; ``und`` and 0 for NULL or a text without a letter."""
    small_batches()
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    @F.arrow_udf("struct<lang: string, score: double>")
    def best_of(texts: pa.Array) -> pa.Array:
        best, share = [np.zeros(0, int)], [np.zeros(0)]
        for part in steps(texts):
            b, s = scores(model, part)
            best.append(b)
            share.append(s)
        at = np.concatenate(best)
        lang = names.take(pa.array(np.where(at < 0, len(names) - 1, at)))
        return pa.StructArray.from_arrays([lang, pa.array(np.concatenate(share))], ["lang", "score"])

    return best_of(text)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the documents that are not held out.

    Repeated rows are predicted each; a NULL id is held out as its empty text says. An empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs["doc_id"])))
    return docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), predict(docs["text"], model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is known with a probability of ``least`` at least.

    The model learns from the rows that have a language and are not held out. NULL and empty texts
    and texts without a letter go; all columns stay as they are.
    """
    model = train(docs.where(~held_out(docs["doc_id"])))
    (name,) = fresh(docs, "language")
    scored = docs.withColumn(name, predict(docs["text"], model))
    return scored.where((scored[name]["lang"] != UNKNOWN) & (scored[name]["score"] >= least)).drop(name)
