"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, labelled as a whole. Each passage is described by shares of
character classes, hashed pairs of classes and word statistics; a layer encodes it; a gated
attention (a tanh and a sigmoid layer, multiplied) weighs the passages of a document, and the score
is a logistic function of the weighted mean of their codes. All weights, those of the attention
too, are learned from document labels alone, by full gradients with Adam.

Training takes a bounded sample to the driver: SAMPLE labelled documents, and of each at most
FIT_PASSAGES passages, spread evenly over the whole text. Scoring sends the weights, a few thousand
numbers, with the function and reads all passages of every text once, where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, steps, table
from .words import Words, mixed, split

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 3000
#: Words of a passage.
PASSAGE = 64
#: Passages of a labelled document that the model is fitted on, at most: 85 MB for the whole sample.
FIT_PASSAGES = 64
#: Width of the code of a passage and of the attention.
CODE, GATE = 24, 12
PAIR_CELLS = 64
ROUNDS, RATE, DECAY = 300, 0.02, 1e-3

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.islower():
            out[b] = 2
        elif c.isupper():
            out[b] = 3
        elif c.isdigit():
            out[b] = 4
        elif c == "\n":
            out[b] = 5
        elif c.isspace():
            out[b] = 6
        elif b in _PUNCTUATION:
            out[b] = 7 + _PUNCTUATION.index(b)
    return out


CLASS = _classes()
CLASSES = 7 + len(_PUNCTUATION)
FEATURES = CLASSES + PAIR_CELLS + 8


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text (and the end of the last).

    A text without words is one passage without words.
    """
    w = split(texts)
    n = np.diff(w.first)
    many = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    total = int(first[-1])
    nth = np.arange(len(w.code)) - w.first[w.doc]
    of_word = first[w.doc] + nth // PASSAGE
    # A passage begins at its first word; the first one of a text at the text's begin.
    opens = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1])) if len(of_word) else np.zeros(0, np.int64)
    begins = np.repeat(w.starts[:-1], many)
    begins[of_word[opens]] = w.begin[opens]
    begins[first[:-1]] = w.starts[:-1]
    sizes = np.diff(np.append(begins, len(w.data)))
    of_byte = np.repeat(np.arange(total), sizes)
    out = np.zeros((total, FEATURES), np.float32)
    kind = CLASS[w.data]
    chars = np.maximum(sizes, 1)[:, None]
    out[:, :CLASSES] = np.bincount(of_byte * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / chars
    if len(kind) > 1:
        cell = (mixed(np.arange(CLASSES * CLASSES)) % np.uint64(PAIR_CELLS)).astype(np.int64)
        pair = cell[kind[:-1] * CLASSES + kind[1:]]
        same = of_byte[1:] == of_byte[:-1]
        out[:, CLASSES : CLASSES + PAIR_CELLS] = (
            np.bincount(of_byte[1:][same] * PAIR_CELLS + pair[same], minlength=total * PAIR_CELLS).reshape(total, PAIR_CELLS) / chars
        )
    out[:, CLASSES + PAIR_CELLS :] = word_features(w, of_word, total)
    return out, first


def word_features(w: Words, of_word: np.ndarray, total: int) -> np.ndarray:
    """Per passage: words, distinct and immediately repeated ones, their lengths and letter cases."""
    out = np.zeros((total, 8), np.float32)
    n = np.bincount(of_word, minlength=total)
    out[:, 0] = np.log1p(n)
    if not len(of_word):
        return out
    per = np.maximum(n, 1)
    span = int(w.code.max()) + 1
    distinct = np.unique(of_word * span + w.code)
    out[:, 1] = np.bincount(distinct // span, minlength=total) / per
    again = (w.code[1:] == w.code[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, 2] = np.bincount(of_word[1:][again], minlength=total) / per
    out[:, 3] = np.bincount(of_word, weights=w.size, minlength=total) / per / 10
    out[:, 4] = np.bincount(of_word, weights=w.size > 24, minlength=total) / per
    kind = CLASS[w.data[w.begin]]
    out[:, 5] = np.bincount(of_word, weights=kind == 3, minlength=total) / per
    ends = CLASS[w.data[w.begin + w.size - 1]]
    out[:, 6] = np.bincount(of_word, weights=ends >= 7, minlength=total) / per
    out[:, 7] = np.bincount(of_word, weights=w.size == 1, minlength=total) / per
    return out


@dataclass(frozen=True)
class Model:
    """Weights by name; an empty dictionary scores every text with ``prior``."""

    weights: dict[str, np.ndarray]
    prior: float = 0.5

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(first) - 1, self.prior)
        return forward(self.weights, self.scaled(x), first)["score"]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.weights["mean"]) / self.weights["spread"], -6, 6).astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """All layers for passages ``x`` of bags that begin at ``first``."""
    code = np.tanh(x @ p["encode"] + p["encode_bias"])
    value, gate = np.tanh(code @ p["value"]), sigmoid(code @ p["gate"])
    raw = (value * gate) @ p["attend"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    raw = np.exp(raw - np.maximum.reduceat(raw, first[:-1])[bag])
    weight = raw / np.add.reduceat(raw, first[:-1])[bag]
    pooled = np.add.reduceat(weight[:, None] * code, first[:-1])
    return {
        "code": code, "value": value, "gate": gate, "weight": weight, "bag": bag, "pooled": pooled,
        "score": sigmoid(pooled @ p["out"] + p["out_bias"]),
    }


def gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean cross entropy."""
    f = forward(p, x, first)
    error = (f["score"] - y) / len(y)
    g = {"out": f["pooled"].T @ error, "out_bias": np.array([error.sum()])}
    to_pooled = (error[:, None] * p["out"])[f["bag"]]
    to_weight = (to_pooled * f["code"]).sum(1)
    mean = np.add.reduceat(f["weight"] * to_weight, first[:-1])[f["bag"]]
    to_raw = f["weight"] * (to_weight - mean)
    g["attend"] = (f["value"] * f["gate"]).T @ to_raw
    inner = to_raw[:, None] * p["attend"]
    to_value = inner * f["gate"] * (1 - f["value"] ** 2)
    to_gate = inner * f["value"] * f["gate"] * (1 - f["gate"])
    g["value"], g["gate"] = f["code"].T @ to_value, f["code"].T @ to_gate
    to_code = to_pooled * f["weight"][:, None] + to_value @ p["value"].T + to_gate @ p["gate"].T
    to_code *= 1 - f["code"] ** 2
    g["encode"], g["encode_bias"] = x.T @ to_code, to_code.sum(0)
    return g


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Weights for bags of passages with labels 0 and 1; one class only gives its share as prior."""
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(7)
    fixed = {"mean": x.mean(0), "spread": x.std(0) + 1e-3}
    p = {
        "encode": draw.normal(0, FEATURES**-0.5, (FEATURES, CODE)),
        "encode_bias": np.zeros(CODE),
        "value": draw.normal(0, CODE**-0.5, (CODE, GATE)),
        "gate": draw.normal(0, CODE**-0.5, (CODE, GATE)),
        "attend": draw.normal(0, 0.1, GATE),
        "out": draw.normal(0, CODE**-0.5, CODE),
        "out_bias": np.zeros(1),
    }
    x = Model(fixed).scaled(x)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, ROUNDS + 1):
        for k, g in gradients(p, x, first, y).items():
            g = g + DECAY * p[k] / 10 if k != "out_bias" else g
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            step = (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
            p[k] = p[k] - RATE * (1 - 0.9 * t / ROUNDS) * step
    return Model(fixed | p)


def spread(begin: int, end: int, most: int = FIT_PASSAGES) -> np.ndarray:
    """The numbers from ``begin`` up to ``end``, or ``most`` of them, the first and last included."""
    n = end - begin
    return begin + (np.arange(n) if n <= most else np.arange(most) * (n - 1) // (most - 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents, drawn by a hash of their id.

    Rows with a NULL label or id are not used; of several labels of one document the lowest counts, of
    several texts the first in their order.
    """
    small_batches()
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit("quality"), F.col("doc_id")), "doc_id")
        .limit(most)
    )

    def describe(batches):
        for batch in batches:
            at = 0
            for part in steps(batch.column(2)):
                x, first = passages(part)
                rows = batch.slice(at, len(part))
                at += len(part)
                bags = [x[spread(a, b)].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(bags, pa.binary())], names=["doc_id", "label", "x"])

    # At most `most` rows of two integers are broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = picked.mapInArrow(describe, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags], dtype=np.int64)])
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, first, np.array([r["label"] for r in rows], np.float64))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text; NULL and empty texts are a bag of one empty passage."""
    small_batches()

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in steps(texts):
            out.append(model.score(*passages(part)))
        return pa.array(np.concatenate(out))

    return of(text)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model of the labelled documents that are not held out.

    Repeated rows are scored each; a NULL id is held out as its empty text says. An empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(labels["doc_id"])))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"], model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
