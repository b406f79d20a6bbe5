"""What both classifiers share: a bounded, stratified sample of labelled rows, and calibration of margins."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pinned


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


class Sample(NamedTuple):
    """features: one array a row, as the feature function gave them; label: 0 or 1; shift: what turns a log odds in the sample into one in the labelled corpus; prior: log odds of label 1."""

    features: list[np.ndarray]
    label: np.ndarray
    shift: float
    prior: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, features, id_col: str = "doc_id", most_bytes: int = 1 << 28) -> Sample:
    """Features and labels of at most ``most`` labelled documents, half of each class where there are enough.

    ``labels`` rows count where ``keep`` holds and neither id nor label is null; a label over 0 is 1. Of an id that
    is labelled twice the larger label holds. The sample is that with the least hashes of the ids, the same on every
    run; its ids, of which there are at most ``most``, are broadcast to the documents. ``features`` maps a DataFrame
    (id, text) to (id, features binary of uint32); of an id's repeated rows one stays. Features of ``most_bytes`` in all
    come to the driver: where very long texts have more, the sample ends before the one that passes it.
    """
    known = (
        labels.where(keep)
        .select(labels[id_col].alias("id"), F.when(labels[label] > 0, 1).otherwise(0).alias("y"), labels[label].alias("given"))
        .where("id is not null and given is not null")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [counts.get(0, 0), counts.get(1, 0)]
    half = most // 2
    few = min(total)
    share = [min(total[y], half if few >= half else most - few if total[y] > few else few) for y in (0, 1)]
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(share[y])
        picked = part if picked is None else picked.union(part)
    texts = docs.select(docs[id_col].alias("id"), docs["text"].alias("text")).join(F.broadcast(picked.select("id")), "id", "left_semi")
    made = features(texts).groupBy("id").agg(F.min("features").alias("features"))
    table = pinned(made.join(F.broadcast(picked), "id").withColumn("turn", F.xxhash64("id")), "sample")
    sizes = table.select("turn", "id", F.octet_length("features").alias("n")).orderBy("turn", "id").collect()
    fit = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_bytes, "right")) if sizes else 0
    if fit < len(sizes):
        edge = sizes[max(fit, 1) - 1]
        table = table.where((F.col("turn") < edge["turn"]) | ((F.col("turn") == edge["turn"]) & (F.col("id") <= edge["id"])))
    rows = table.orderBy("turn", "id").select("y", "features").collect()
    label_of = np.array([r["y"] for r in rows], np.int64)
    odds = lambda a, b: float(np.log((a + 0.5) / (b + 0.5)))
    prior = odds(total[1], total[0])
    return Sample([np.frombuffer(bytes(r["features"]), np.uint32) for r in rows], label_of, prior - odds(label_of.sum(), (1 - label_of).sum()), prior)


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the sigmoid that fits labels to margins, with Platt's smoothed targets, by Newton steps."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.array([1.0, 0.0])
    ridge = np.array([1e-3, 1e-6])
    loss = lambda t: float(np.logaddexp(0, x @ t).sum() - target @ (x @ t) + 0.5 * (ridge * (t - [1, 0]) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (p - target) + ridge * (theta - [1, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-4:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
