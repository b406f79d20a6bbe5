"""Toxicity by a bag of subword embeddings, averaged into a linear softmax and trained jointly with it in numpy.

A text's bag holds its distinct byte n-grams (n = 3 to 5) within words, word ends marked by a space, hashed into
DIM buckets: misspelt or inflected words share most vectors with those seen in training. For scoring, each
bucket's vector is multiplied out with the softmax's weights once, so that a text's log odds are an average of numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .labelled import calibrate, labelled_sample, sigmoid

DIM = 1 << 17
SIZES = (3, 4, 5)


def subword_buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """Buckets of all subwords of each text, repeated as they occur; empty for a text without words."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) < 400_000):
            held += len(texts[hi])
            hi += 1
        parts = [f" {' '.join(t.lower().split())} ".encode() for t in texts[lo:hi]]
        ends = np.cumsum([len(p) for p in parts])
        b = np.frombuffer(b"".join(parts), np.uint8)
        space = b == 32
        of_doc: list[list[np.ndarray]] = [[] for _ in parts]
        wide = b.astype(np.uint32)
        for n in SIZES:
            m = len(b) - n + 1
            if m <= 0:
                continue
            h, ok = np.full(m, n * 97531, np.uint32), np.ones(m, bool)
            for j in range(n):
                h = h * np.uint32(16777619) ^ wide[j : j + m]
                if 0 < j < n - 1:
                    ok &= ~space[j : j + m]
            ok &= ~(space[:m] & space[n - 1 :] & (n == 2))
            h *= np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            at = np.flatnonzero(ok)
            bucket = (h[at] >> np.uint32(15)).astype(np.int64)
            # a window over two texts holds the two spaces where they meet: the last of one, the first of the next
            cut = np.searchsorted(at, np.concatenate(([0], ends)))
            for i in range(hi - lo):
                stop = np.searchsorted(at[cut[i] : cut[i + 1]], ends[i] - n, "right") + cut[i]
                of_doc[i].append(bucket[cut[i] : stop])
        for found in of_doc:
            yield np.concatenate(found) if found else np.empty(0, np.int64)
        lo = hi


class Model(NamedTuple):
    """weight: each bucket's part of the log odds; offset: that of every text; slope: of the calibrated average."""

    weight: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str]) -> np.ndarray:
        out, seen = np.zeros(len(texts)), np.zeros(DIM, bool)
        for i, bag in enumerate(subword_buckets(texts)):
            if len(bag):
                seen[bag] = True
                own = np.flatnonzero(seen)
                out[i] = self.weight[own].mean()
                seen[own] = False
        return sigmoid(self.slope * out + self.offset)


def train_embeddings(bags: list[np.ndarray], label: np.ndarray, width: int = 6, epochs: int = 4, rate: float = 0.5, seed: int = 0) -> tuple[np.ndarray, float]:
    """(log-odds weight of each bucket, bias) of embeddings and softmax trained together by adaptive gradient steps.

    Vectors start near zero, so that subwords never seen in training say next to nothing.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (DIM, width)).astype(np.float32)
    weights = rng.normal(0, 0.5, (2, width)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    spent = np.full(DIM, 1e-8, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bag = bags[i]
            if not len(bag):
                continue
            mean = vectors[bag].mean(axis=0)
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = p @ weights
            weights -= np.float32(0.05) * np.outer(p, mean)
            bias -= np.float32(0.05) * p
            share = np.float32(1 / len(bag))
            spent[bag] += np.square(share * np.abs(back).max())
            vectors[bag] -= (np.float32(rate) * share / np.sqrt(spent[bag]))[:, None] * back
    return (vectors @ (weights[1] - weights[0])).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = 4000, **options) -> Model:
    """A model from at most ``most`` labelled rows for which ``keep`` holds (see labelled_sample); a fourth of them calibrates it.

    With labels of fewer than two classes the score is the smoothed share of label 1, 0.5 without any.
    """

    def features(texts: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [np.unique(b).astype(np.uint32).tobytes() for b in subword_buckets([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "features"])

        return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, features binary")

    sample = labelled_sample(docs, labels, label, keep, most, features)
    y = sample.label
    if min(y.sum(), (1 - y).sum()) < 2:
        return Model(np.zeros(DIM), 1.0, sample.prior)
    own = np.arange(len(y)) % 4 != 3
    if len(y) < 400 or min(y[~own].sum(), (1 - y[~own]).sum()) < 5:
        own[:] = True
    weight, bias = train_embeddings([sample.features[i] for i in np.flatnonzero(own)], y[own], **options)
    test = np.flatnonzero(~own) if not own.all() else np.arange(len(y))
    margin = np.array([(weight[sample.features[i]].mean() if len(sample.features[i]) else 0.0) + bias for i in test])
    slope, offset = calibrate(margin, y[test])
    return Model(weight, slope, slope * bias + offset + sample.shift)


def scores(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, score (0 to 1), predicted (1 if score >= ``threshold``, else 0).

    One pass over whole texts, no shuffle; the model is of fixed size. Null is scored as the empty text, which has the
    score of an empty bag. Equal texts score equal. An empty table gives no rows; columns other than id and text
    aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = own.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs["text"].alias("t")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
