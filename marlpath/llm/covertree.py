"""Hard-negative mining: windowed inner-product search through cover trees over norm-augmented candidates.

1. Candidates get one more component, the root of the largest squared norm less their own: all then lie on one sphere,
   and the cap of a ball around a centre bounds the inner products with an anchor from both sides.
2. The tree's top level is made of pivots, chosen from a bounded sample farthest first. Each candidate goes to its
   nearest pivot; a pivot's candidates are dealt over blocks of bounded size. Every block is a cover tree whose
   covering radii halve from level to level.
3. An anchor's positives come from the blocks that can hold one: first from the block with the best bound, then from
   those whose bound reaches the last positive found there.
4. Each positive sets a window of scores. Anchors ask the blocks whose bounds meet a window; the descent takes nodes best
   first, leaves out those outside all windows or below the found ones, and verifies leaves by exact whole-number scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import keyed, matrix, meet, parts_of, sampled, usable_vectors
from .frames import few, pinned

LEAF = 24
EXACT = 1 << 53


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """``vectors`` with one more component, so that each has the squared norm ``top``."""
    rest = np.sqrt(np.maximum(0.0, top - (vectors * vectors).sum(axis=1)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (places), each point's centre and its distance: centres are added, the farthest point first, until there are ``most`` or all points are within ``radius``."""
    centres, of = [0], np.zeros(len(points), np.int64)
    apart = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(centres) < most:
        far = int(apart.argmax())
        if apart[far] <= radius:
            break
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = d < apart
        of[closer], apart[closer] = len(centres), d[closer]
        centres.append(far)
    return np.array(centres), of, apart


def bounds(anchor: np.ndarray, norm: float, centres: np.ndarray, radii: np.ndarray, sphere: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of an anchor with any point of the sphere within ``radii`` of ``centres``, with room for rounding.

    ``centres`` lie on the sphere and have one component more than ``anchor``. A point within r of a centre is
    within the angle 2 asin(r / 2 sphere) of it.
    """
    if norm == 0 or sphere == 0:
        return np.full(len(centres), -1.0), np.full(len(centres), 1.0)
    own = centres[:, :-1] @ anchor
    angle = np.arccos(np.clip(own / (norm * sphere), -1.0, 1.0))
    wide = 2 * np.arcsin(np.clip(radii / (2 * sphere), 0.0, 1.0))
    room = 1e-6 * norm * sphere + 0.5
    return norm * sphere * np.cos(np.minimum(np.pi, angle + wide)) - room, norm * sphere * np.cos(np.maximum(0.0, angle - wide)) + room


class CoverTree:
    """Levels of nodes over one block: each node's centre and covering radius, at least halved from level to level, and its children; leaves hold points."""

    def __init__(self, points: np.ndarray):
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.points: list[np.ndarray] = []
        self.root = self._node(points, np.arange(len(points)), 0)

    def _node(self, points: np.ndarray, own: np.ndarray, first: int) -> int:
        waiting = [(own, first, -1)]
        slots: dict[int, list[int]] = {}
        while waiting:
            own, middle, parent = waiting.pop()
            apart = np.sqrt(((points[own] - points[own[middle]]) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(points[own[middle]])
            self.radius.append(float(apart.max()))
            self.children.append(None)
            self.points.append(own)
            if parent >= 0:
                slots.setdefault(parent, []).append(node)
            if len(own) <= LEAF or self.radius[node] == 0:
                continue
            centres, of, _ = farthest_first(np.roll(points[own], -middle, axis=0), len(own), self.radius[node] / 2)
            if len(centres) * 4 > len(own):  # nothing is gained below
                continue
            own = np.roll(own, -middle)
            for i, c in enumerate(centres.tolist()):
                mine = np.flatnonzero(of == i)
                waiting.append((own[mine], int(np.searchsorted(mine, c)), node))
        for parent, found in slots.items():
            self.children[parent] = np.array(found)
        self.centres, self.radii = np.stack(self.centre), np.array(self.radius)
        return 0


def wanted_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Candidates of one block under their cover tree; it answers with each window's first ``k``."""

    def __init__(self, rows: pa.RecordBatch, sphere2: float, k: int, same: bool):
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.vectors = matrix(rows.column("vec"))
        self.sphere, self.k, self.same = math.sqrt(sphere2), k, same
        self.tree = CoverTree(augmented(self.vectors, sphere2))

    def search(self, anchor_id: int, label: int, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first ``k`` in each window [low, high], best first."""
        tree, norm = self.tree, float(np.sqrt(anchor @ anchor))
        none = np.empty(0, np.int64)
        found, floor = [(none, none)] * len(low), low.astype(np.float64)
        todo = [np.array([tree.root])]
        while todo:
            nodes = np.concatenate(todo)
            least, most = bounds(anchor, norm, tree.centres[nodes], tree.radii[nodes], self.sphere)
            open_ = ((most[:, None] >= floor[None, :]) & (least[:, None] <= high[None, :])).any(axis=1)
            nodes, most = nodes[open_], most[open_]
            order = np.argsort(-most, kind="stable")
            nodes, todo, leaves, held = nodes[order], [], [], 0
            for at, node in enumerate(nodes.tolist()):
                if tree.children[node] is not None:
                    todo.append(tree.children[node])
                    continue
                leaves.append(tree.points[node])
                held += len(leaves[-1])
                if held >= 256:  # the best leaves first: what they hold may close the others
                    todo.append(nodes[at + 1 :])
                    break
            if leaves:
                own = np.concatenate(leaves)
                own = own[(self.ids[own] != anchor_id) & ((self.labels[own] == label) == self.same)]
                scores = (self.vectors[own] @ anchor).astype(np.int64)
                for i in range(len(low)):
                    fits = (scores >= low[i]) & (scores <= high[i])
                    ids, values = np.concatenate((found[i][0], self.ids[own[fits]])), np.concatenate((found[i][1], scores[fits]))
                    best = wanted_of(values, ids, self.k)
                    found[i] = ids[best], values[best]
                    if len(best) == self.k:
                        floor[i] = max(floor[i], float(values[best[-1]]))
        return found

    def __call__(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for anchor_id, label, anchor, low, high in zip(asked.column("id").to_pylist(), asked.column("label").to_pylist(), matrix(asked.column("vec")), asked.column("low").to_pylist(), asked.column("high").to_pylist()):
            for i, (ids, scores) in enumerate(self.search(anchor_id, label, anchor, np.array(low, np.int64), np.array(high, np.int64))):
                for own, values in zip(out, (np.full(len(ids), anchor_id), np.full(len(ids), i), ids, scores)):
                    own.append(values)
        cols = [np.concatenate(o or [np.empty(0, np.int64)]).astype(np.int64) for o in out]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], ["anchor_id", "win", "other_id", "score"])


ANSWER = "anchor_id long, win int, other_id long, score long"


class Pivots:
    """The tree's top level: pivots, and the covering radius and number of blocks of each."""

    def __init__(self, points: np.ndarray, sphere2: float):
        self.points, self.sphere2 = points, sphere2
        self.radii, self.parts = np.full(len(points), -1.0), np.zeros(len(points), np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = augmented(vectors, self.sphere2)
        of = np.concatenate([(own[i : i + 1024] @ self.points.T).argmax(axis=1) for i in range(0, len(own), 1024)] or [np.empty(0, np.int64)])
        return of, np.sqrt(((own - self.points[of]) ** 2).sum(axis=1))


def dealt(candidates: DataFrame, pivots) -> DataFrame:
    """``candidates`` with their pivot and the distance to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, apart = pivots.value.nearest(matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(apart)], [*batch.schema.names, "pivot", "apart"])

    return candidates.mapInArrow(run, "id long, label long, vec array<double>, pivot int, apart double")


def routed(anchors: DataFrame, pivots, which: str) -> DataFrame:
    """``anchors`` (id, label, vec, low, high) once for each block that they ask: of the ``best`` pivot, of the ``other`` ones that can reach a window, or of ``all`` that can."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        there = np.flatnonzero(p.parts > 0)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows, pivot, part = [], [], []
                for i, (anchor, low, high) in enumerate(zip(matrix(batch.column("vec")), batch.column("low").to_pylist(), batch.column("high").to_pylist())):
                    least, most = bounds(anchor, float(np.sqrt(anchor @ anchor)), p.points[there], p.radii[there], math.sqrt(p.sphere2))
                    best = int(most.argmax())
                    if which == "best":
                        own = [best]
                    else:
                        meets = ((most[:, None] >= np.array(low)[None, :]) & (least[:, None] <= np.array(high)[None, :])).any(axis=1)
                        meets[best] &= which == "all"
                        own = np.flatnonzero(meets).tolist()
                    for j in there[own].tolist():
                        rows += [i] * int(p.parts[j])
                        pivot += [j] * int(p.parts[j])
                        part += range(int(p.parts[j]))
                found = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(part, pa.int32()), *found.columns], ["pivot", "part", *batch.schema.names])

    return anchors.mapInArrow(run, f"pivot int, part int, {ASKED}")


ASKED = "id long, label long, vec array<double>, low array<long>, high array<long>"
MOST = (1 << 62) - 1


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low_percent: int = 80, block: int = 1024, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` of other labels in the window.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Components become
    floor(``scale`` * x); scores are whole inner products, higher ones first, ties by smaller id. A negative's score n is
    in the window of a positive's p if low_percent * p <= 100 * n <= 100 * p, so a negative p has none. The rows are those of
    comparing every anchor with every row; what pivots and trees leave out can't be in a window.

    Rows with a null label, id or vector, with a null or non-finite component, or with another length than most take no
    part; of rows with one id one stays. Zero vectors score 0. Equal vectors lie in one pivot's candidates, which are
    dealt over blocks of ``block`` rows. Raises ArithmeticError where scores could pass 2**53. No rows from an empty table; other
    columns aren't read.
    """
    spark = rows.sparkSession
    whole = usable_vectors(rows.where(label.isNotNull()), id_col, vec_col, zero=True, more={"label": label.cast("long"), "_anchor": is_anchor})
    whole = pinned(whole.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))), "whole")
    facts = whole.select(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    if facts["top"] >= EXACT:
        raise ArithmeticError("scores of these vectors pass the range of exact whole numbers")
    candidates, sphere2 = whole.select("id", "label", "vec"), float(facts["top"])
    learned = augmented(sampled(whole, sample), sphere2)
    points = learned[farthest_first(learned, min(4096, math.ceil(facts["n"] / block)))[0]]
    pivots = Pivots(points, sphere2)
    placed = pinned(dealt(candidates, spark.sparkContext.broadcast(pivots)), "placed")
    counts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
    counts = pinned(counts, "counts")
    for r in counts.collect():  # a row for each pivot: 4,096 at most
        pivots.radii[r["pivot"]], pivots.parts[r["pivot"]] = r["radius"], math.ceil(r["n"] / block)
    shared = spark.sparkContext.broadcast(pivots)
    held = keyed(placed, parts_of(counts.drop("radius"), block), ["pivot"], F.xxhash64("id"))
    held = held.select("pivot", "part", "id", "label", "vec", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    anchors = pinned(whole.where("_anchor").select("id", "label", "vec"), "anchors")

    def asked(which: str, windows: DataFrame, k: int, same: bool) -> DataFrame:
        opened = lambda key, batch: Block(batch, sphere2, k, same)
        return meet(held, routed(windows, shared, which), ["pivot", "part"], opened, ANSWER)

    windows = anchors.withColumns({"low": F.array(F.lit(-MOST)), "high": F.array(F.lit(MOST))})
    near = pinned(first_of(asked("best", windows, positives, True), ["anchor_id"], positives), "near")
    reach = near.where(F.col("rank") == positives).select(F.col("anchor_id").alias("id"), F.col("score").alias("reach"))
    windows = anchors.join(reach, "id", "left").select("id", "label", "vec", F.array(F.coalesce("reach", F.lit(-MOST))).alias("low"), F.array(F.lit(MOST)).alias("high"))
    more = asked("other", windows, positives, True)
    chosen = pinned(first_of(near.drop("rank").union(more), ["anchor_id"], positives), "positives")
    low = F.expr(f"({low_percent} * score + 99 - pmod({low_percent} * score + 99, 100)) div 100")
    spans = chosen.where("score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("win"), low.alias("low"), F.col("score").alias("high")))).alias("w"))
    windows = anchors.join(spans.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = first_of(asked("all", windows, negatives, False), ["anchor_id", "win"], negatives)
    positive = chosen.select("anchor_id", (F.col("rank") - 1).alias("win"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor_id", "win"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
