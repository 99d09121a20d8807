"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are the words and punctuation runs of the lower-cased text and their
pairs, hashed into ``2 ** bits`` slots; a text's counts are scaled to length
one. Scores are sparse dot products with a weight vector of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import LOWER

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\x20\x09-\x0Da-z0-9\x80-\xff]+")


class _Hashes(dict):
    """CRC-32 of tokens, kept for a bounded number of them."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[token] = zlib.crc32(token)
        return value


_HASHES = _Hashes()


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text's features; none for null, empty and blank texts."""
    tokens = TOKEN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint32, len(tokens))
    pairs = h[:-1] * np.uint32(0x9E3779B1) + (h[1:] ^ (h[1:] >> np.uint32(15))) * np.uint32(0x85EBCA77)
    both = np.concatenate([h ^ (h >> np.uint32(16)), pairs ^ (pairs >> np.uint32(13))])
    slots, counts = np.unique(both & np.uint32((1 << bits) - 1), return_counts=True)
    return slots, counts / max(np.sqrt(np.square(counts, dtype=np.float64).sum()), 1.0)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal updates of a logistic regression; slot ``2 ** bits`` is the intercept."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(slots)
        g = (_sigmoid(w @ values) - label) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def train_quality(
    docs: DataFrame, labels: DataFrame, max_train_docs: int = 8000, bits: int = 18, epochs: int = 3, folds: int = 5
) -> np.ndarray:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    Learns from labelled rows whose crc32(doc_id as text) mod ``folds`` is not
    0: from at most ``max_train_docs`` doc_ids, those with the smallest hashes,
    which is a bounded uniform sample. A doc_id with several labels counts as 1
    if at least half of them are; null ids and labels are ignored. A doc_id is
    one example however many rows it has: that with the smallest text. Texts are
    read whole, features are extracted in parallel, and one task makes the
    updates over the bounded sample. Without any label all
    weights are zero, and every score is 0.5.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (
        labels.filter("quality is not null and doc_id is not null")
        .filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
        .orderBy(order, "doc_id")
        .limit(max_train_docs)
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t, bits) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "at": b["at"],
                    "label": b["label"],
                    "slots": [s.astype(np.uint32).tobytes() for s, _ in found],
                    "vals": [v.astype(np.float32).tobytes() for _, v in found],
                }
            )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.itertuples(index=False)]
        rows.sort(key=lambda r: (r.at, r.slots, r.vals, r.label))
        model = Ftrl(bits)
        for _ in range(epochs):
            for r in rows:
                model.update(np.frombuffer(r.slots, np.uint32).astype(np.int64), np.frombuffer(r.vals, np.float32), r.label)
        yield pd.DataFrame({"w": [model.weights(slice(None)).astype(np.float32).tobytes()]})

    # reduced before the shuffle: a doc_id may have a third of all rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    examples = rows.select(order.alias("at"), "label", "text")
    got = examples.mapInPandas(extract, "at long, label int, slots binary, vals binary").repartition(1)
    rows = got.mapInPandas(learn, "w binary").collect()
    return np.frombuffer(rows[0]["w"], np.float32).astype(np.float64) if rows else np.zeros((1 << bits) + 1)


def quality_score(text, weights: np.ndarray):
    """Column of P(quality = 1) of a text column. Null and empty texts get the intercept's score."""
    bits = (len(weights) - 1).bit_length() - 1
    held = SparkSession.active().sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = held.value
        out = []
        for t in texts:
            slots, values = features(t, bits)
            out.append(float(_sigmoid(w[slots] @ values + w[-1])))
        return pd.Series(out, dtype="float64")

    return score(text)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept."""
    weights = train_quality(docs, labels, **options)
    return docs.filter(quality_score(F.col("text"), weights) >= threshold)
