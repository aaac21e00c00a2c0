"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its tokens: hashed words, hashed character n-grams, and a
mark wherever a word repeats one of the four words before it. A softmax over two classes stands on that mean.
Both are trained by numpy stochastic gradient descent on a bounded sample of labelled rows.

Defined cases: a null text counts as empty; a text without tokens gets the score of the bias alone; a null or
repeated doc_id is scored like any other row; an empty table gives an empty result; other columns pass through
untouched, and input columns named `score` or `predicted` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, codes, held_out, sample_texts, set_aside, span_hashes, spans

BITS, DIM, ORDERS, LAGS = 17, 8, (2, 3, 4), (1, 2, 3, 4)
_SLOTS = (1 << BITS) + 1024


def _ngrams(code: np.ndarray, n: int) -> np.ndarray:
    """The slot of the n-gram at each position."""
    h = np.full(max(0, len(code) - n + 1), n * 0x01000193, np.uint32)
    for k in range(n):
        h ^= code[k : len(code) - n + 1 + k]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _words(code: np.ndarray, ends: np.ndarray):
    """Slots of words and of repeat marks, each with the document it is in."""
    inside = code > 32
    inside &= (code != 0xA0) & (code != 0x3000)
    # a word never runs from one text into the next
    start, end = spans(inside)
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(code))]
    cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
    start, end = np.sort(np.concatenate((start, np.unique(cut)))), np.sort(np.concatenate((end, np.unique(cut))))
    doc = np.searchsorted(ends, start, "right") - 1
    h = span_hashes(code, start, end)
    out = [(h >> np.uint64(64 - BITS)).astype(np.int64)]
    docs = [doc]
    for lag in LAGS:
        same = np.flatnonzero((h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])) + lag if len(h) > lag else np.zeros(0, np.int64)
        out.append(np.full(len(same), (1 << BITS) + lag, np.int64))
        docs.append(doc[same])
    return np.concatenate(out), np.concatenate(docs)


def tokens_of(text: str, orders: tuple = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and how often each occurs."""
    code, ends = codes([text])
    slots = [_ngrams(code, n).astype(np.int64) for n in orders] + [_words(code, ends)[0]]
    return np.unique(np.concatenate(slots), return_counts=True)


class SubwordModel:
    """Vectors of the slots, a softmax on their mean, and its classes."""

    def __init__(self, classes: list, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, orders: tuple):
        self.classes, self.vectors, self.weights, self.bias, self.orders = classes, vectors, weights, bias, orders

    @classmethod
    def train(cls, rows: list[tuple], least_steps: int = 5000, rate: float = 0.5, seed: int = 7, orders: tuple = ORDERS) -> SubwordModel:
        """rows: (id, label, text); orders: of the character n-grams beside the words; least_steps: the rows are gone through
        so often that this many steps are made, 3 times at least and 40 at most. The vectors and the softmax learn together, one document at a time."""
        classes = sorted({label for _, label, _ in rows}) or [0, 1]
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (_SLOTS, DIM)).astype(np.float32)
        weights, bias = np.zeros((DIM, len(classes)), np.float32), np.zeros(len(classes), np.float32)
        share = np.array([sum(label == c for _, label, _ in rows) for c in classes], float)
        bias[:] = np.log(np.maximum(share, 1) / max(1, share.sum()))
        bags = []
        for _, label, text in rows:
            slots, count = tokens_of(text, orders)
            bags.append((slots.astype(np.int32), (count / max(1, count.sum())).astype(np.float32), classes.index(label)))
        epochs = min(40, max(3, -(-least_steps // max(1, len(bags)))))
        steps, done = max(1, epochs * len(bags)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                slots, part, y = bags[i]
                if not len(slots):
                    continue
                lr = rate * (1 - done / steps)
                done += 1
                mean = part @ vectors[slots]
                z = mean @ weights + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = weights @ p
                weights -= lr * np.outer(mean, p)
                bias -= 0.1 * lr * p
                # a token's share of the mean is small, so its vector takes the step of the whole mean, weighted by that share's root
                vectors[slots] -= lr * np.sqrt(part)[:, None] * back
        return cls(classes, vectors, weights, bias, orders)

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of class logits a text. The softmax's input is linear in the mean, so a slot stands for its logits."""
        out = np.zeros((len(texts), len(self.classes)))
        if len(self.classes) == 2:  # only the difference matters
            tables = [None, (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)]
            base = self.bias - self.bias[0]
        else:
            tables = [np.ascontiguousarray(self.vectors @ self.weights[:, k]) for k in range(len(self.classes))]
            base = self.bias
        for a, b in batches(texts):
            code, ends = codes(texts[a:b])
            length = np.diff(ends)
            words, doc = _words(code, ends)
            n = np.bincount(doc, minlength=b - a).astype(float)
            sums = np.zeros((b - a, len(tables)))
            for k, table in enumerate(tables):
                if table is not None:
                    sums[:, k] = np.bincount(doc, table[words], minlength=b - a)
            for order in self.orders:
                slot = _ngrams(code, order)
                here = np.maximum(0, length - order + 1)
                first = np.minimum(ends[:-1], len(slot))
                last = np.minimum(first + here, len(slot))
                n += here
                for k, table in enumerate(tables):
                    if table is not None:
                        total = np.concatenate(([0.0], np.cumsum(table[slot], dtype=np.float64)))
                        sums[:, k] += total[last] - total[first]
            out[a:b] = sums / np.maximum(n, 1)[:, None]
        return out + base

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts)
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return p / p.sum(1, keepdims=True)


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, label: str = "quality") -> SubwordModel:
    """Learns from at most `max_rows` labelled rows outside the held-out fold, chosen by a hash of the id."""
    return SubwordModel.train(sample_texts(docs, labels.where(~held_out()), label, max_rows))


def score_quality(docs: DataFrame, model: SubwordModel, threshold: float = 0.3) -> DataFrame:
    """Adds score (probability of class 1) and predicted (1 if score >= threshold) to every row."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*kept)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    positive = model.classes.index(1) if 1 in model.classes else None

    def run(frames):
        m = shipped.value
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist() if len(pdf) else []
            p = m.probabilities(texts)[:, positive] if positive is not None else np.zeros(len(texts))
            yield pdf.assign(score=p.astype(float), predicted=(p >= threshold).astype(np.int32))

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInPandas(run, schema)


def good_rows(docs: DataFrame, model: SubwordModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are predicted to be of class 1, with their own columns and values, whatever their names."""
    renamed, own = set_aside(docs, ("score", "predicted"))
    return own(score_quality(renamed, model, threshold).where("predicted = 1"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; the text itself doesn't leave the scoring stage."""
    model = train_quality(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    positive = model.classes.index(1) if 1 in model.classes else None

    def run(frames):
        for pdf in frames:
            texts = pdf["text"].tolist()
            p = shipped.value.probabilities(texts)[:, positive] if positive is not None else np.zeros(len(texts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p.astype(float), "predicted": (p >= threshold).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
