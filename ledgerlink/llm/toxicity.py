"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguise: compatibility forms, look-alike letters of other scripts, digits and signs
that stand for letters, and invisible characters; ``l`` and ``i`` become one letter, since ``1`` and
``|`` stand for either. Accents stay: they tell words of several languages apart. Folded words are
joined by single spaces, so a term with a space before it is a word's beginning and one with a space
on both sides a whole word or phrase.

The lexicon is learned from labelled documents. Terms are beginnings of words; the weight of one is
the log ratio of its mean share among the words of toxic and of other documents (a document's share
counts up to MOST_SHARE, so that junk which repeats one word can't make a term). Of each word the
longest term counts. Exception phrases hold a term but are found in other documents rather than in
toxic ones; a word inside such a phrase does not count. The score is a logistic function of the
summed weights, by themselves and divided by the number of words.

Fitting takes a bounded sample of labelled documents (SAMPLE of each label); counts of terms and
phrases are added up by Spark, and the driver gets at most CANDIDATES of them. Scoring sends the
lexicon with the function and reads every whole text once, where it lies.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, held_out, small_batches, steps, table, written

#: Labelled documents of each label that the lexicon is learned from, at most.
SAMPLE = 3000
#: Terms and phrases that are considered, at most: those found in the most documents.
CANDIDATES = 20_000
#: Characters of the beginning of a word that may be a term.
SHORTEST, LONGEST = 4, 12
#: Documents of the sample that must hold a term, or a phrase.
LEAST_DOCS = 4
#: What a document's share of a word counts for at most, and what is added to mean shares.
MOST_SHARE, SMOOTH = 0.03, 2e-5
#: Weight of a term at least: it is about twelve times as frequent in toxic documents. Terms from
#: MAYBE_WEIGHT on are looked at again without their exceptions.
LEAST_WEIGHT, MAYBE_WEIGHT = 2.5, 1.5
#: A longer term stands beside its own beginning if its weight is higher by this.
HIGHER = 0.7

# Letters that look like a Latin one, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ӏ": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = str.maketrans(LOOK_ALIKES | DIGITS | dict.fromkeys(INVISIBLE, ""))
_ASCII_TABLE = str.maketrans(DIGITS)
_SIGN = re.compile(r"[@$!|](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """Words of a text, folded; signs stand for letters only right before a letter or digit."""
    if text.isascii():
        text = text.lower().translate(_ASCII_TABLE)
    else:
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    return _WORD.findall(_SIGN.sub(lambda m: SIGNS[m.group()], text))


@dataclass
class Lexicon:
    """Weights by term and exception phrases, all folded, with spaces where words begin or end."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    _automaton: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "_automaton": None}

    def found(self, words: list[str]) -> list[tuple[int, str]]:
        """Place in the folded text and term of each word that counts; the longest term of a word."""
        if not self.terms or not words:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for text in {*self.terms, *self.exceptions}:
                self._automaton.add_word(text, text)
            self._automaton.make_automaton()
        best: dict[int, str] = {}
        covered: list[tuple[int, int]] = []
        spared = set(self.exceptions)
        for end, text in self._automaton.iter(f" {' '.join(words)} "):
            at = end - len(text) + 1
            if text in spared:
                covered.append((at, end))
            if text in self.terms and len(text) > len(best.get(at, "")):
                best[at] = text
        if covered:
            covered.sort()
            begins = [a for a, _ in covered]
            reach = list(accumulate((b for _, b in covered), max))  # how far the phrases up to each one go
            best = {at: t for at, t in best.items() if not ((k := bisect_right(begins, at)) and reach[k - 1] >= at + len(t.rstrip()) - 1)}
        return sorted(best.items())

    def weight(self, words: list[str]) -> float:
        return sum(self.terms[t] for _, t in self.found(words))


@dataclass
class Model:
    """A lexicon with the logistic function of (bias, weight per 100 words, weight)."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    factors: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def score(self, texts: list[str]) -> np.ndarray:
        words = [fold(t) for t in texts]
        weight = np.array([self.lexicon.weight(w) for w in words], float)
        n = np.array([len(w) for w in words], float)
        return sigmoid(inputs(weight, n) @ np.array(self.factors))


def inputs(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.log1p(100 * weight / np.maximum(n, 1)), np.log1p(weight)], 1).reshape(-1, 3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def shares(words: list[str]) -> dict[str, float]:
    """Share of a document's words that begin with, or are, each possible term, up to MOST_SHARE."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            counts[f" {word[:k]}"] += n
        if len(word) >= SHORTEST:
            counts[f" {word} "] += n
    return {t: min(n / len(words), MOST_SHARE) for t, n in counts.items()}


def found_shares(words: list[str], lexicon: Lexicon) -> dict[str, float]:
    """Share of a document's words that count for each term, up to MOST_SHARE."""
    return {t: min(n / len(words), MOST_SHARE) for t, n in Counter(t for _, t in lexicon.found(words)).items()}


def phrases(words: list[str], lexicon: Lexicon) -> set[str]:
    """The words that count, alone and with the word before or after."""
    begin = {}
    at = 0
    for i, w in enumerate(words):
        begin[at] = i
        at += len(w) + 1
    out = set()
    for place, _ in lexicon.found(words):
        i = begin[place]
        out.add(f" {words[i]} ")
        out.update(f" {a} {b} " for a, b in zip(words[max(0, i - 1) : i + 1], words[max(1, i) : i + 2]))
    return out


def counted(sample: DataFrame, describe) -> DataFrame:
    """(term, toxic, docs, share) over a sample (toxic, text): documents with a term and their shares,
    added up in each task first. ``describe`` turns a document's words into shares by term."""

    def run(batches):
        docs: dict[tuple[str, int], int] = defaultdict(int)
        share: dict[tuple[str, int], float] = defaultdict(float)
        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                for toxic, text in zip(batch.column(0).slice(at, len(part)).to_pylist(), part):
                    for term, s in describe(fold(text)).items():
                        docs[term, toxic] += 1
                        share[term, toxic] += s
                at += len(part)
        keys = list(docs)
        for a in range(0, len(keys), 50_000):
            own = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in own], pa.string()),
                    pa.array([x for _, x in own], pa.int32()),
                    pa.array([docs[k] for k in own], pa.int64()),
                    pa.array([share[k] for k in own], pa.float64()),
                ],
                names=["term", "toxic", "docs", "share"],
            )

    found = sample.select("toxic", "text").mapInArrow(run, "term string, toxic int, docs long, share double")
    # Sums of rounded shares do not depend on the order of the tasks.
    return found.groupBy("term", "toxic").agg(F.sum("docs").alias("docs"), F.sum(F.col("share").cast("decimal(30,12)")).cast("double").alias("share"))


def weights(toxic: dict[str, float], clean: dict[str, float]) -> dict[str, float]:
    """Log ratios of mean shares in toxic and in other documents."""
    return {t: float(np.log((s + SMOOTH) / (clean.get(t, 0.0) + SMOOTH))) for t, s in toxic.items()}


def choose(toxic: dict[str, float], clean: dict[str, float]) -> dict[str, float]:
    """Terms that may be in the lexicon, with their weights.

    A beginning whose share one longer beginning nearly has gives way to that one: it names a word.
    """
    weight = weights(toxic, clean)
    longest: dict[str, float] = defaultdict(float)
    for t, s in toxic.items():
        if not t.endswith(" "):
            longest[t[:-1]] = max(longest[t[:-1]], s)
    chosen: dict[str, float] = {}
    for t in sorted(weight, key=lambda t: (len(t), t)):
        if weight[t] < MAYBE_WEIGHT or (not t.endswith(" ") and longest[t] >= 0.9 * toxic[t]):
            continue
        begin = max((chosen[t[:k]] for k in range(1, len(t)) if t[:k] in chosen), default=-np.inf)
        if weight[t] >= begin + HIGHER:
            chosen[t] = weight[t]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Factors by Newton's method, with a small penalty on all but the first."""
    penalty = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) * weight.sum()
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ b)
        slope = x.T @ (weight * (p - y)) + penalty @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        b -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """A lexicon and its score from labelled documents, at most ``most`` of each label.

    They are drawn by a hash of the id. Rows with a NULL label or id are not used; of several labels of
    one document the lowest counts, of several texts the lowest. Without documents of both labels the
    lexicon is empty and every score is the share of label 1, or 0.5 without labels.
    """
    small_batches()
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min(label).cast("int").alias("toxic"))
    )
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        share = total.get(1, 0) / sum(total.values()) if total else 0.5
        return Model(factors=(float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0))
    drawn = F.xxhash64(F.lit("toxic"), F.col("labelled"))
    chosen = [known.where(F.col("toxic") == x).orderBy(drawn, "labelled").limit(most) for x in (0, 1)]
    # At most 2 * most rows of two integers are broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("labelled"))
    sample = written(picked.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        drop(sample)
        return Model(factors=(float(np.log((size.get(1, 0) + 1) / (size.get(0, 0) + 1))), 0.0, 0.0))

    frequent = counted(sample.where("toxic = 1"), shares).where(F.col("docs") >= LEAST_DOCS)
    rows = frequent.orderBy(F.desc("docs"), "term").limit(CANDIDATES).collect()
    in_toxic = {r["term"]: r["share"] / size[1] for r in rows}
    wanted = frozenset(in_toxic)
    rows = counted(sample.where("toxic = 0"), lambda words: {t: s for t, s in shares(words).items() if t in wanted}).collect()
    in_clean = {r["term"]: r["share"] / size[0] for r in rows}
    lexicon = Lexicon(choose(in_toxic, in_clean))

    spoken = counted(sample, lambda words: dict.fromkeys(phrases(words, lexicon), 0.0))
    by_phrase = spoken.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("bad")
    )
    spared = by_phrase.where((F.col("clean") >= LEAST_DOCS) & (3 * F.col("bad") * size[0] < F.col("clean") * size[1]))
    rows = spared.orderBy(F.desc("clean"), "term").limit(CANDIDATES).collect()
    exceptions = tuple(sorted(r["term"] for r in rows))
    # Weights of what is left: words that no longer term and no exception takes.
    maybe = Lexicon(lexicon.terms, exceptions)
    rows = counted(sample, lambda words: found_shares(words, maybe)).collect()
    mean = [{r["term"]: r["share"] / size[x] for r in rows if r["toxic"] == x} for x in (0, 1)]
    lexicon = Lexicon({t: w for t, w in weights(mean[1], mean[0]).items() if w >= LEAST_WEIGHT}, exceptions)

    def measure(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(1)):
                words = [fold(t) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([lexicon.weight(w) for w in words], pa.float64()), pa.array([len(w) for w in words], pa.int64())],
                    names=["toxic", "weight", "n"],
                )
                at += len(part)

    rows = sample.select("toxic", "text").mapInArrow(measure, "toxic int, weight double, n long").collect()  # 2 * most
    rows.sort()
    drop(sample)
    y, weight, n = (np.array([r[i] for r in rows], float) for i in range(3))
    balance = np.where(y == 1, total[1] / size[1], total[0] / size[0])
    return Model(lexicon, tuple(logistic(inputs(weight, n), y, balance / balance.mean()).tolist()))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text; a NULL text counts as empty."""
    small_batches()

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.score(part) for part in steps(texts))]), pa.float64())

    return of(text)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a lexicon of the labelled documents that are not held out.

    Repeated rows are scored each; a NULL id is held out as its empty text says. An empty table gives no
    rows.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(labels["doc_id"])))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"], model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))
