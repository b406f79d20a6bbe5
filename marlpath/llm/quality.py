"""Text quality by naive Bayes support vectors over n-grams of token shapes and of words.

A token's shape is its leading and trailing punctuation and the case of what is between; a token that repeats the
one before it has the shape "again". Indicators of shape n-grams (n = 1 to 3) and word n-grams (n = 1, 2) are scaled by
the classes' log-count ratios, and a linear model with hinge loss is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settled
from .labelled import calibrate, labelled_sample, sigmoid
from .wordstream import chunks, mix, shingles, words

#: Hash cells of shape n-grams, and of word n-grams after them.
SHAPES, WORDS = 1 << 17, 1 << 19
DIM = SHAPES + WORDS
#: A word n-gram counts from so many documents of the sample on.
LEAST = 5
AGAIN = np.uint64(0x51ED270B)
_parts = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


class _Shapes(dict):
    """Token -> 32-bit shape, remembered for up to 120,000 tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 120_000:
            self.clear()
        lead, core, trail = _parts.match(token).groups()
        if not core:
            case = "none"
        elif core.isdigit():
            case = "digits"
        elif core.islower():
            case = "lower"
        elif core[0].isupper() and (len(core) == 1 or core[1:].islower()):
            case = "title"
        else:
            case = "upper" if core.isupper() else "mixed"
        value = self[token] = zlib.crc32(f"{lead[:3]}\0{case}\0{trail[:3]}".encode())
        return value


_shapes = _Shapes()


def shape_ngrams(text: str, longest: int = 3) -> np.ndarray:
    """The distinct hashed shape n-grams of a text, sorted; a text without tokens has the one feature 0."""
    tokens = text.split()
    if not tokens:
        return np.zeros(1, np.uint32)
    v = np.fromiter(map(_shapes.__getitem__, tokens), np.uint64, len(tokens))
    v[1:][np.fromiter(map(str.__eq__, tokens, tokens[1:]), bool, len(tokens) - 1)] = AGAIN
    found = []
    for n in range(1, longest + 1):
        m = len(v) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + v[j : j + m]
                h ^= h >> np.uint64(29)
            found.append((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(47))
    return np.unique(np.concatenate(found)).astype(np.uint32)


def ngrams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct features of each text: its shape n-grams, and its words and pairs of words."""
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi])
        pair, at = shingles(w, 2)
        cell = lambda h: ((mix(h) >> np.uint64(45)) + np.uint64(SHAPES)).astype(np.uint32)
        one, two = cell(w.hash), cell(pair ^ np.uint64(0x5BF03635))
        cut = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = np.concatenate((one[w.first[i] : w.first[i + 1]], two[cut[i] : cut[i + 1]]))
            yield np.concatenate((shape_ngrams(texts[lo + i] or ""), np.unique(own)))


class Model(NamedTuple):
    """Weight of each n-gram indicator, and the sigmoid's offset; ``constant`` where no model could be fitted."""

    weight: np.ndarray
    offset: float

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(self.weight[features].sum() + self.offset))


def nb_support_vectors(features: list[np.ndarray], label: np.ndarray, c: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias): log-count ratios times the weights that dual coordinate descent fits to the scaled indicators, with hinge loss and penalty ``c``."""
    sums = [np.ones(DIM), np.ones(DIM)]
    for f, y in zip(features, label):
        sums[y][f] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    ratio[SHAPES:][(sums[0] + sums[1])[SHAPES:] - 2 < LEAST] = 0
    features = [f[ratio[f] != 0] for f in features]
    sign = 2.0 * label - 1
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(features))
    scaled = [ratio[f].astype(np.float32) for f in features]
    square = np.array([float(x @ x) + 1 for x in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(features)):
            f, x = features[i], scaled[i]
            gradient = sign[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * x
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-7:
            break
    return w * ratio, bias


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = 6000, c: float = 0.001, epochs: int = 20) -> Model:
    """A model from at most ``most`` labelled rows for which ``keep`` holds (see labelled_sample), with calibrated odds.

    With labels of fewer than two classes the score is the smoothed share of label 1, 0.5 without any.
    """

    def features(texts: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [f.tobytes() for f in ngrams(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "features"])

        return texts.mapInArrow(settled(run), f"id {texts.schema['id'].dataType.simpleString()}, features binary")

    sample = labelled_sample(docs, labels, label, keep, most, features)
    y = sample.label
    if min(y.sum(), (1 - y).sum()) < 2:
        return Model(np.zeros(DIM), sample.prior)
    fold, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        own = [i for i in range(len(y)) if fold[i] != k]
        w, bias = nb_support_vectors([sample.features[i] for i in own], y[own], c, epochs)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[sample.features[i]].sum() + bias
    slope, offset = calibrate(margin, y)
    w, bias = nb_support_vectors(sample.features, y, c, epochs)
    return Model(slope * w, slope * bias + offset + sample.shift)


def scores(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, score (0 to 1), predicted (1 if score >= ``threshold``, else 0).

    One pass over whole texts, no shuffle; the model is of fixed size. Null is scored as the empty text. Equal texts
    score equal. An empty table gives no rows; columns other than id and text aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = np.array([own.score(f) for f in ngrams(batch.column(1).to_pylist())], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs["text"].alias("t")).mapInArrow(settled(run), f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject: filtered in one pass, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            good = [own.score(f) >= threshold for f in ngrams(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(settled(run), docs.schema)
