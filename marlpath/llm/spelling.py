"""Spelling variants: words one edit apart, found by k-d trees over letter counts and verified by letter order.

1. Words are counted per task and then by word, so a frequent word is one row a task.
2. A word is a point: how often it holds each letter. One edit moves it by one (a letter put in or left out) or by two
   (one replaced). Words of one length are parted by a k-d tree whose splits come from a bounded sample of them;
   every leaf is a box, dealt over blocks of bounded size.
3. A word asks the boxes of its own and both neighbouring lengths that reach within one edit. In its block a finer k-d
   tree with tight boxes prunes the search, and points within the distance are verified letter by letter.
4. Blocks answer with a number of near words and the best of them for each word: pairs never leave their task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet
from .frames import pinned

#: Letters a to z have a dimension each, all others share the rest by their code; two bits a dimension are 64.
DIMS, PLAIN = 32, 26
#: Words of this length and longer are one class.
LONGEST = 255
HELD = 200_000

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_counts(docs: DataFrame, least: int = 7, least_n: int = 2, drop_one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``least_n`` times or more.

    A word is a maximal run of letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z lower-cased; where ``drop_one_in`` divides the
    crc32 h of "id:run", the run's code point h % length is left out. Null texts have no words, a null id counts as
    an empty one, and rows of one id all count. Whole texts are read; other columns aren't. No rows from an empty table.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                before = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for run, n in Counter(run_of.findall(text.encode().translate(_lower).decode())).items():
                    h = zlib.crc32(run.encode(), before)
                    if h % drop_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
                if len(total) > HELD:
                    yield out()
        if total:
            yield out()

    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Spelled:
    """Words as code points, lengths and points.

    A point's coordinates are letter counts up to 2, written in unary as two bits each (0, 1, 3) of one number: the L1
    distance of two points is the number of bits in which they differ. That counts above 2 are alike shortens distances only.
    """

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        code = self.flat.astype(np.int64)
        dim = np.where((code >= 97) & (code <= 122), code - 97, PLAIN + code % (DIMS - PLAIN))
        cells = np.repeat(np.arange(len(words)), self.length) * DIMS + dim
        counts = np.bincount(cells, minlength=len(words) * DIMS).reshape(-1, DIMS)
        self.points = np.packbits(np.stack((counts > 0, counts > 1), axis=2).reshape(len(words), 2 * DIMS), axis=1).view("<u8").ravel()

    def letters(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.flat[self.first[at][:, None] + np.arange(length)]


def one_edit(a: Spelled, i: np.ndarray, b: Spelled, j: np.ndarray) -> np.ndarray:
    """Which pairs of words a[i], b[j] differ by exactly one code point put in, left out or replaced."""
    out = np.zeros(len(i), bool)
    la, lb = a.length[i], b.length[j]
    for x, y in {*zip(la.tolist(), lb.tolist())}:
        if abs(x - y) > 1:
            continue
        own = np.flatnonzero((la == x) & (lb == y))
        p, q = a.letters(i[own], x), b.letters(j[own], y)
        if x == y:
            out[own] = (p != q).sum(axis=1) == 1
            continue
        long, short = (p, q) if x > y else (q, p)
        head = np.logical_and.accumulate(long[:, :-1] == short, axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
        out[own] = head + tail >= short.shape[1]
    return out


BITS = [np.uint64(1 << b) for b in range(64)]


def best_split(points: np.ndarray) -> int | None:
    """The bit (a dimension and a limit) that halves the points best; None if all are equal."""
    ones = np.unpackbits(points.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    uneven = np.where((ones == 0) | (ones == len(points)), len(points) + 1, np.abs(2 * ones - len(points)))
    bit = int(uneven.argmin())
    return bit if uneven[bit] <= len(points) else None


def apart(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of points from boxes: what lacks to the lower bounds and what is above the upper ones."""
    return np.bitwise_count((low & ~points) | (points & ~high))


class Boxes:
    """The upper k-d tree of one length: leaves are boxes between split planes."""

    def __init__(self, sample: np.ndarray, leaves: int):
        done, waiting = [], [(sample, np.uint64(0), ~np.uint64(0))]
        while waiting:
            waiting.sort(key=lambda node: len(node[0]))
            points, low, high = waiting.pop()
            bit = best_split(points) if len(points) and len(done) + len(waiting) + 1 < leaves else None
            if bit is None:
                done.append((low, high))
                continue
            right = points & BITS[bit] != 0
            waiting += [(points[~right], low, high & ~BITS[bit]), (points[right], low | BITS[bit], high)]
        self.low, self.high = (np.array([d[k] for d in done], np.uint64) for k in (0, 1))

    def within(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, box) for all boxes within ``reach`` of each point; within 0 it is the one box that holds it."""
        found = [np.flatnonzero(apart(points, low, high) <= reach) for low, high in zip(self.low, self.high)]
        return np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])


class Tree:
    """A k-d tree over a block's points with tight boxes; leaves are ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        self.order = np.arange(len(points))
        self.low, self.high, self.kids, self.range = [], [], [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            lo, hi, parent = waiting.pop()
            own = points[self.order[lo:hi]]
            node = len(self.low)
            self.low.append(np.bitwise_and.reduce(own))
            self.high.append(np.bitwise_or.reduce(own))
            self.kids.append([-1, -1])
            self.range.append((lo, hi))
            if parent >= 0:
                self.kids[parent][0 if self.kids[parent][0] < 0 else 1] = node
            if hi - lo <= leaf or (bit := best_split(own)) is None:
                continue
            right = own & BITS[bit] != 0
            self.order[lo:hi] = np.concatenate((self.order[lo:hi][~right], self.order[lo:hi][right]))
            middle = hi - int(right.sum())
            waiting += [(lo, middle, node), (middle, hi, node)]
        self.low, self.high, self.kids, self.range = np.array(self.low), np.array(self.high), np.array(self.kids), np.array(self.range)
        self.points = points[self.order]

    def near(self, points: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``points``, place of the held point) of all pairs within ``reach``, some at a time."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        while len(q):
            keep = apart(points[q], self.low[node], self.high[node]) <= reach[q]
            q, node = q[keep], node[keep]
            end = self.kids[node, 0] < 0
            lo, hi = self.range[node[end]].T
            who, n = q[end], hi - lo
            # leaves whose pairs begin in one stretch of PAIRS go together; a leaf of equal points may have up to a block's
            stretch = (np.cumsum(n) - n) // PAIRS
            cut = (np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist() if len(n) else []
            for a, b in zip([0, *cut], [*cut, len(n)]):
                w = np.repeat(who[a:b], n[a:b])
                at = np.arange(len(w)) + np.repeat(lo[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b])
                close = np.bitwise_count(points[w] ^ self.points[at]) <= reach[w]
                yield w[close], self.order[at[close]]
            q, node = np.repeat(q[~end], 2), self.kids[node[~end]].ravel()


#: Pairs of points that are compared at a time.
PAIRS = 1 << 19


class Block:
    """Words of one box under a k-d tree, in order of preference as a form: larger n first, then code points."""

    def __init__(self, kind: int, rows: pa.RecordBatch):
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.kind, self.n, self.held = kind, n[order], Spelled([words[i] for i in order])
        self.tree = Tree(self.held.points)

    def __call__(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(asked), 2048):
            own = Spelled(asked.column("word").slice(lo, 2048).to_pylist())
            reach = np.where(np.minimum(own.length, LONGEST) == self.kind, 2, 1)
            found = []
            for i, j in self.tree.near(own.points, reach):
                true = one_edit(own, i, self.held, j)
                found.append((i[true], j[true]))
            i, j = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
            count = np.bincount(i, minlength=len(own.words))
            best = np.full(len(own.words), len(self.n))
            np.minimum.at(best, i, j)
            met = np.flatnonzero(count)
            words = [[own.words[k] for k in met.tolist()], [self.held.words[k] for k in best[met].tolist()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[0], pa.string()), pa.array(count[met].astype(np.int64)), pa.array(self.n[best[met]], pa.int64()), pa.array(words[1], pa.string())],
                ["word", "n_near", "best_n", "best"],
            )


class Plan:
    """For each class of lengths its boxes and in how many turns it is asked, and of each box the number of blocks."""

    def __init__(self):
        self.boxes: dict[int, Boxes] = {}
        self.turns: dict[int, int] = {}
        self.parts: dict[tuple[int, int], int] = {}


def boxed(words: DataFrame, plan) -> DataFrame:
    """``words`` (word, n) with kind (the class of its length) and box."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Spelled(batch.column("word").to_pylist())
            kind = np.minimum(own.length, LONGEST)
            box = np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                of = np.flatnonzero(kind == k)
                at, found = plan.value.boxes[k].within(own.points[of], 0)
                box[of[at]] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind.astype(np.int32)), pa.array(box.astype(np.int32))], ["word", "n", "kind", "box"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, kind int, box int")


def asking(words: DataFrame, plan) -> DataFrame:
    """``words`` once for each block that may hold a near word: kind, box, part, turn, word, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            own = Spelled(batch.column("word").to_pylist())
            kind = np.minimum(own.length, LONGEST)
            rows, kinds, boxes, parts, turns = [], [], [], [], []
            for k in np.unique(kind).tolist():
                of = np.flatnonzero(kind == k)
                for other in {k - 1, k, min(k + 1, LONGEST)} & p.boxes.keys():
                    at, found = p.boxes[other].within(own.points[of], 2 if other == k else 1)
                    n = np.array([p.parts.get((other, b), 0) for b in range(len(p.boxes[other].low))])[found]
                    rows.append(np.repeat(of[at], n))
                    boxes.append(np.repeat(found, n))
                    kinds.append(np.full(len(rows[-1]), other))
                    parts.append(np.arange(len(rows[-1])) - np.repeat(np.cumsum(n) - n, n))
                    turns.append(rows[-1] % p.turns[other])
            at, *cols = (np.concatenate(c or [np.empty(0, np.int64)]) for c in (rows, kinds, boxes, parts, turns))
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cols], *taken.columns], ["kind", "box", "part", "turn", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "kind int, box int, part int, turn int, word string, n long")


def planned(words: DataFrame, block: int, sample: int) -> Plan:
    """The upper trees: splits from at most ``sample`` words, those of the least hashes, and the number of words of each class from all."""
    plan = Plan()
    kind = F.least(F.length("word"), F.lit(LONGEST))
    sizes = {r["kind"]: r["n"] for r in words.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # LONGEST rows at most
    table = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).toArrow()
    own = Spelled(table.column("word").to_pylist())
    own_kind = np.minimum(own.length, LONGEST)
    for k, n in sizes.items():
        points = own.points[own_kind == k]
        plan.boxes[k] = Boxes(points, max(1, min(math.ceil(n / block), len(points) // 16)))
        plan.turns[k] = math.ceil(sum(sizes.get(other, 0) for other in (k - 1, k, k + 1)) / (2 * block))
    return plan


def near_words(words: DataFrame, block: int = 1 << 16, sample: int = 1 << 16) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct) that have a near one: how many, and the one of largest n, ties by code points.

    A block is held by as many tasks as it takes for each to answer some 2 * ``block`` words.
    """
    spark = words.sparkSession
    plan = planned(words, block, sample)
    own = pinned(boxed(words, spark.sparkContext.broadcast(plan)), "boxed")
    for r in own.groupBy("kind", "box").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each box, whose number the sample bounds
        plan.parts[r["kind"], r["box"]] = math.ceil(r["n"] / block)
    shared = spark.sparkContext.broadcast(plan)
    table = spark.createDataFrame([(k, b, n, plan.turns[k]) for (k, b), n in plan.parts.items()] or [(0, 0, 1, 1)], "kind int, box int, parts int, turns int")
    held = own.join(F.broadcast(table), ["kind", "box"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    held = held.select("kind", "box", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "turn", "word", "n")
    found = meet(held, asking(own, shared), ["kind", "box", "part", "turn"], lambda key, rows: Block(key[0], rows), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def variants(words: DataFrame, ratio: int = 10, block: int = 1 << 16, sample: int = 1 << 16) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of ``words`` (word, n): the near word of largest n, if that is ``ratio`` times the word's, and where forms lead.

    Near words are one code point put in, left out or replaced apart; every pair is found. Ties go to the smaller word in
    code-point order. root follows forms to the last one; as n grows with each step, their number is bounded by
    the largest n. Null words take no part; of repeated words the counts add up. No rows from an empty table.
    """
    words = pinned(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words, block, sample)
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    known = pinned(
        words.join(near, "word", "left").select(
            "word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log(max(most, 2), ratio))).bit_length()):  # each step doubles the forms followed
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = pinned(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
