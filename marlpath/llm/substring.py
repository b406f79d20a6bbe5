"""Substring dedup: passages that documents share, exactly or with edits, by seeds, collinear chains and alignment.

1. Seeds of a document are those k-mers of words whose hash falls into one ``rate``-th of all, whatever stands
   around them. Beside them stand keys that no part of a passage holds, so that excerpts can't hide who shares it all:
   long keys, hashes of ``min_words`` words in a row, of every ``spread`` neighbours the least (any shared run of
   ``min_words`` + ``spread`` - 1 words has one), and span keys, hashes of two seeds: each seed with that of the least hash
   among those that end ``min_words`` to ``min_words`` + REACH words after it begins. Of these the words between may differ.
2. Each occurrence of a repeated seed is an anchor to its first document and to the last one before its own, that of a
   key to the first: two links an occurrence at most, however often the seed occurs, never all pairs.
3. The anchors of two documents are chained in text order. The best chain pays for the words it skips (an L1 gap
   cost), and a Fenwick tree of prefix maxima finds each anchor's best predecessor.
4. Chains are aligned word by word, between their anchors and outwards from both ends, as far as the score of a banded
   alignment does not fall by ``DROP``; passages of ``min_words`` and ``similarity`` identity are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import few, pinned, released, settled, shuffle_width
from .neardup import repeats_ids, with_texts
from .wordstream import chunks, mix, runs, shingles, words

#: Words beyond its anchors with which a chain is first aligned; those that go on there are aligned again with more, at last with all.
MARGINS = (48, 1024, None)
#: Score of an equal word and of a changed, added or left out one; an alignment ends where its score has fallen by DROP.
GAIN, LOSS, DROP = 1, 2, 12
BAND = 8
SIDES_A_ROW = 256
#: In how many words after ``min_words`` of them a span key may end.
REACH = 30


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the seeds among a text's k-mer hashes: each window's minimum; of a run of equal minima the first."""
    if len(h) <= window:
        return np.array([int(h.argmin())]) if len(h) else np.empty(0, np.int64)
    low, have = h, 1
    while have < window:
        step = min(have, window - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    high = np.concatenate((np.full(window - 1, low[0]), low, np.full(window - 1, low[-1])))
    have = 1
    while have < window:
        step = min(have, window - have)
        high = np.maximum(high[: len(high) - step], high[step:])
        have += step
    at = np.flatnonzero(high == h)
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1] + 1) & (h[at[1:]] == h[at[:-1]])
    return at[~again]


def spans(h: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first seeds, places of the last ones, hashes) of the span keys of seeds in text order; ``at`` counts on over all texts."""
    lo = np.searchsorted(at, at + (min_words - k))
    end = np.searchsorted(doc, doc, "right")
    hi = np.minimum(np.searchsorted(at, at + (min_words - k + REACH), "right"), end)
    first = np.flatnonzero(lo < hi)
    lo, n = lo[first], (hi - lo)[first]
    turn = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    last, least = lo.copy(), turn[lo]
    for step in range(1, int(n.max(initial=0))):
        own = np.flatnonzero(n > step)
        other = turn[lo[own] + step]
        less = other < least[own]
        last[own[less]], least[own[less]] = lo[own[less]] + step, other[less]
    return first, last, mix(mix(h[first]) + least)


def seeds(docs: DataFrame, k: int, rate: int, min_words: int, spread: int, id_col: str, text_col: str) -> DataFrame:
    """(id, at, size, seed): at is the word at which the seed's k-mer begins; size is 0, or how much later the last k-mer of a key begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                w = words(texts[lo:hi])
                h, at = shingles(w, k)
                own = (h >> np.uint64(33)) % np.uint64(rate) == 0
                h, at = h[own], at[own]
                hashes, begin, size = [h], [at], [np.zeros(len(at), np.int64)]
                first, last, key = spans(h, at, w.doc[at], k, min_words)
                hashes.append(key), begin.append(at[first]), size.append(at[last] - at[first])
                long, start = runs(w, min_words)
                if len(long):
                    cut = np.searchsorted(w.doc[start], np.arange(hi - lo + 1))
                    picked = np.concatenate([cut[i] + winnow(long[cut[i] : cut[i + 1]], spread) for i in range(hi - lo) if cut[i] < cut[i + 1]])
                    hashes.append(long[picked]), begin.append(start[picked]), size.append(np.full(len(picked), min_words - k))
                h, at, size = np.concatenate(hashes), np.concatenate(begin), np.concatenate(size)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc + lo)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64))],
                    ["id", "at", "size", "seed"],
                )

    return (
        docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("t"))
        .where("id is not null and t is not null")
        .mapInArrow(settled(run), "id long, at int, size int, seed long")
    )


def hot_seeds(sample: DataFrame, share: int = 4) -> DataFrame:
    """(seed, parts) of the seeds that hold more than one ``share`` * width-th of the sampled occurrences: at most share * width seeds.

    Those with fewer than 150 sampled ones, some 10,000 in all, are no burden to a task.
    """
    width = share * shuffle_width(sample.sparkSession)
    counts = pinned(sample.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n >= 150"), "counts")
    total = sample.count()
    parts = F.ceil(F.col("n") * width / F.lit(max(1, total))).cast("int")
    return counts.select("seed", parts.alias("parts")).where("parts > 1")


def linked(occurrences: DataFrame, keys: list[str], min_words: int) -> DataFrame:
    """(x, y, px, py, size, seed) with x < y: from each occurrence of a seed to that of the first document with it and of the last one before.

    Rows with a null x are the first of their keys and hand on (y, py, size, seed). Rows stream by in order; a task only keeps
    the first and the last row of the seed at hand. A key gives an anchor at each of its ends. Occurrences that follow
    another in the same document within ``min_words`` words give none: the alignment reaches them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        last = first = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if last is not None:
                cols = [np.concatenate(([f, v], c)) for f, v, c in zip(first, last, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:n]], axis=0)
            at = np.arange(len(new))
            start = np.maximum.accumulate(np.where(new, at, 0))
            own = at if last is None else at[2:]
            doc, place, size, seed = *cols[-3:], cols[0]
            first, last = [c[start[-1]] for c in cols], [c[-1] for c in cols]
            heads = own[new[own]]
            own = own[~new[own]]
            # of occurrences in one document less than a passage apart, as in a line said over and over, the first speaks for all
            own = own[(doc[own] != doc[own - 1]) | (np.abs(place[own] - place[own - 1]) >= min_words)]
            to_first = own[doc[own] != doc[start[own]]]
            before = own - 1
            also = (doc[before] != doc[own]) & (doc[before] != doc[start[own]]) & (size[own] == 0)
            frm, to = np.concatenate((start[to_first], before[also])), np.concatenate((to_first, own[also]))
            end = np.flatnonzero(size[to] != 0)
            xs, ys = np.concatenate((doc[frm], doc[frm[end]])), np.concatenate((doc[to], doc[to[end]]))
            px, py = np.concatenate((place[frm], (place + size)[frm[end]])), np.concatenate((place[to], (place + size)[to[end]]))
            none = len(xs)
            heads = heads[cols[1][heads] >= 0] if "part" in keys else heads[:0]
            zero = np.zeros(len(heads), np.int64)
            xs, ys, px, py = (np.concatenate(c) for c in ((xs, zero), (ys, doc[heads]), (px, zero), (py, place[heads])))
            sizes, seeds_of = (np.concatenate((np.zeros(none, np.int64), c[heads])) for c in (size, seed))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(xs, pa.int64(), mask=np.arange(len(xs)) >= none), pa.array(ys, pa.int64()),
                    *[pa.array(c.astype(np.int32)) for c in (px, py, sizes)], pa.array(seeds_of, pa.int64(), mask=np.arange(len(xs)) < none),
                ],
                ["x", "y", "px", "py", "size", "seed"],
            )

    dealt = occurrences.repartition(*keys).sortWithinPartitions(*keys, "id", "at").select(*keys, "id", "at", "size")
    return dealt.mapInArrow(settled(run), "x long, y long, px int, py int, size int, seed long")


def anchors(found: DataFrame, sample: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """A written table, and made from it (x, y, px, py) with x < y: the anchors of all seeds.

    Seeds that are frequent in ``sample`` (some of the occurrences) are dealt over several tasks: there each
    occurrence is linked within its part, and then the first ones of all parts with each other.
    """
    hot = F.broadcast(hot_seeds(sample))
    part = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), "parts")).cast("int")
    made = pinned(linked(found.join(hot, "seed", "left").withColumn("part", part), ["seed", "part"], min_words), "anchors")
    firsts = made.where("x is null").select("seed", F.col("y").alias("id"), F.col("py").alias("at"), "size")
    return made, made.where("x is not null").drop("seed", "size").union(linked(firsts, ["seed"], min_words).where("x is not null").drop("seed", "size"))


class Fenwick:
    """Maxima over prefixes of the ranks 0 .. n-1, with the index that holds each."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def raise_to(self, rank: int, value: float, index: int) -> None:
        i = rank + 1
        while i < len(self.best):
            if self.best[i][0] < value:
                self.best[i] = (value, index)
            i += i & -i

    def prefix(self, ranks: int) -> tuple[float, int]:
        found, i = (-1e18, -1), ranks
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def fragments(px: np.ndarray, py: np.ndarray, k: int, step: int) -> list[tuple[int, int, int]]:
    """(px, py, words) of maximal runs of anchors on one diagonal at most ``step`` words apart, by px."""
    order = np.lexsort((px, px - py))
    x, d = px[order], (px - py)[order]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] - x[:-1] > step)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    out = [(int(a), int(a - b), int(c - a) + k) for a, b, c in zip(x[first], d[first], x[last])]
    out.sort()
    return out


def chain(parts: list[tuple[int, int, int]], skip_cost: float, max_gap: int) -> list[list[tuple[int, int, int]]]:
    """Disjoint collinear chains of fragments, best first; each is cut where it skips over ``max_gap`` words.

    A chain's score is its words less ``skip_cost`` for each word between fragments in either text. Fragments that
    overlap their predecessor by a few words still follow it, as they begin later in both texts.
    """
    if len(parts) == 1:
        return [parts]
    ys = sorted({p[1] for p in parts})
    rank = {y: i for i, y in enumerate(ys)}
    tree, score, before = Fenwick(len(ys)), [0.0] * len(parts), [-1] * len(parts)
    waiting: list[int] = []
    for i, (x, y, n) in enumerate(parts):
        if waiting and parts[waiting[-1]][0] < x:
            for j in waiting:
                tree.raise_to(rank[parts[j][1]], score[j] + skip_cost * (parts[j][0] + parts[j][1] + 2 * parts[j][2]), j)
            waiting = []
        value, j = tree.prefix(rank[y])
        gain = value - skip_cost * (x + y)
        score[i], before[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
        waiting.append(i)
    used, found = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        path, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(parts[j])
            j = before[j]
        path.reverse()
        now: list[tuple[int, int, int]] = []
        for p in path:
            if now and max(p[0] - now[-1][0] - now[-1][2], p[1] - now[-1][1] - now[-1][2]) > max_gap:
                found.append(now)
                now = []
            now.append(p)
        if now:
            found.append(now)
    return found


def joined(found: list[list[tuple[int, int, int]]], far: int) -> list[list[tuple[int, int, int]]]:
    """Chains that go on, at most ``far`` words later, on nearly the same diagonal are one: whether the words between match is seen when they are aligned."""
    out: list[list[tuple[int, int, int]]] = []
    for one in sorted(found):
        x, y, _ = one[0]
        for other in out[:-5:-1]:
            a, b, n = other[-1]
            if 0 < x - a <= far + n and 0 < y - b <= far + n and abs((x - y) - (a - b)) <= BAND:
                other.extend(one)
                break
        else:
            out.append(list(one))
    return out


def chains(links: DataFrame, k: int, step: int, max_gap: int, far: int) -> DataFrame:
    """(chain, x, y, frags, lo0, lo1, hi0, hi1): the chains of two anchors at least of each pair of documents, and where they begin and end in either.

    A pair's anchors come sorted to one task and are held together: they are at most two a seed of the later text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4

        def work(x, y, px, py):
            first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            last = np.append(first[1:], len(x))
            span = np.maximum.reduceat(py, first) - np.minimum.reduceat(py, first) + k
            for i in np.flatnonzero(span >= 2 * k).tolist():
                a, b = first[i], last[i]
                for found in joined(chain(fragments(px[a:b], py[a:b], k, step), 0.1, max_gap), far):
                    if max(f[1] + f[2] for f in found) - found[0][1] >= 2 * k:
                        own = np.array(found, "<i4")
                        yield int(x[a]), int(y[a]), own.tobytes(), *own[0, :2].tolist(), *(own[:, :2] + own[:, 2:]).max(axis=0).tolist()

        def batch_of(rows):
            rows = list(rows)
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["x", "y", "frags", "lo0", "lo1", "hi0", "hi1"])

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, batch.columns)]
            x, y = cols[0], cols[1]
            if not len(x):
                continue
            tail = len(x) - int(np.argmax((x != x[-1])[::-1] | (y != y[-1])[::-1])) if ((x != x[-1]) | (y != y[-1])).any() else 0
            held = [c[tail:] for c in cols]
            if tail:
                yield batch_of(work(*(c[:tail] for c in cols)))
        if len(held[0]):
            yield batch_of(work(*held))

    dealt = links.repartition("x", "y").sortWithinPartitions("x", "y", "py", "px")
    return dealt.mapInArrow(settled(run), "x long, y long, frags binary, lo0 int, lo1 int, hi0 int, hi1 int").withColumn("chain", F.monotonically_increasing_id())


def extend(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How far matches go on from the starts of each ``a`` and ``b``: (words of a, words of b, matches, 1 if it went on at the end of a, plus 2 if at that of b).

    Banded alignment of all pairs side by side; each ends where its best score has fallen by more than DROP.
    """
    count, width = len(a), 2 * BAND + 1
    ea, eb, got, open_ = (np.zeros(count, np.int64) for _ in range(4))
    size = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    who = np.flatnonzero(size.min(axis=1) > 0)
    open_[:] = (size[:, 0] == 0) + 2 * (size[:, 1] == 0)
    one, low = 1 << 24, -(1 << 50)
    shift = np.arange(width) - BAND
    best = np.zeros(count, np.int64)
    score = np.full((len(who), width), low, np.int64)
    score[:, BAND:] = -LOSS * one * np.arange(BAND + 1)
    row, block = 0, 64
    while len(who):
        # the next words of those that still go on, in a block of rows
        here = min(block, int(size[who, 0].max()) - row)
        if here <= 0:
            break
        left = np.zeros((len(who), here), np.uint32)
        right = np.zeros((len(who), here + width), np.uint32)
        for r, i in enumerate(who.tolist()):
            x, y = a[i][row : row + here], b[i][max(0, row - BAND) : row + here + BAND + 1]
            left[r, : len(x)] = x
            skip = max(0, BAND - row)
            right[r, skip : skip + len(y)] = y
        alive = np.ones(len(who), bool)
        for t in range(here):
            i = row + t
            j = i + shift
            inside = (j >= -1)[None, :] & (j[None, :] < size[who, 1][:, None]) & (i < size[who, 0])[:, None]
            same = right[:, t : t + width] == left[:, t : t + 1]
            new = np.where(same, score + GAIN * one + 1, score - LOSS * one)
            new[:, :-1] = np.maximum(new[:, :-1], score[:, 1:] - LOSS * one)
            new = np.where(inside, new, low)
            ramp = LOSS * one * np.arange(width)
            new = np.where(inside, np.maximum.accumulate(new + ramp, axis=1) - ramp, low)
            at = new.argmax(axis=1)
            top = new[np.arange(len(who)), at]
            better = alive & (top > best[who]) & same[np.arange(len(who)), at]
            own = who[better]
            best[own], ea[own], eb[own], got[own] = top[better], i + 1, i + shift[at[better]] + 1, top[better] & (one - 1)
            ended = alive & (top <= low // 2)
            open_[who[ended]] = np.where(i >= size[who[ended], 0], 1, 2)
            alive &= ~ended & (top >= best[who] - DROP * one)
            score = new
            if not alive.any():
                break
        score, who = score[alive], who[alive]
        row += here
    open_[who] = 1
    return ea, eb, got, open_


def gap_columns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which columns match in an alignment of two stretches: as many as the longer has words.

    Long ones may differ by words put in or left out at one place, short ones anywhere.
    """
    n = max(len(a), len(b))
    out = np.zeros(n, bool)
    if not len(a) or not len(b):
        return out
    if len(a) == len(b) and (a == b).mean() > 0.5:
        return a == b
    if n > 64:
        m = min(len(a), len(b))
        head, tail = a[:m] == b[:m], a[len(a) - m :] == b[len(b) - m :]
        t = int(np.argmax(np.concatenate(([0], np.cumsum(head))) - np.concatenate(([0], np.cumsum(tail)))))
        out[:t], out[n - m + t :] = head[:t], tail[t:]
        return out
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == word))
        np.maximum.accumulate(row, out=row)
    out[(np.arange(int(row[-1])) * n) // max(1, int(row[-1]))] = True
    return out


def columns(a: np.ndarray, b: np.ndarray, frags: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chain's alignment from its first to its last anchor: per column, whether its words match, and the place in either text."""
    match, pa_, pb = [], [], []
    e0, e1 = frags[0][0], frags[0][1]
    for p, q, n in frags:
        lap = max(0, e0 - p, e1 - q)  # what a fragment shares with those before it counts once
        p, q, n = p + lap, q + lap, n - lap
        if n <= 0:
            continue
        if p > e0 or q > e1:
            found = gap_columns(a[e0:p], b[e1:q])
            match.append(found)
            pa_.append(np.minimum(e0 + np.arange(len(found)), p))
            pb.append(np.minimum(e1 + np.arange(len(found)), q))
        match.append(a[p : p + n] == b[q : q + n])
        pa_.append(np.arange(p, p + n))
        pb.append(np.arange(q, q + n))
        e0, e1 = p + n, q + n
    return np.concatenate(match), np.concatenate(pa_), np.concatenate(pb)


def stretches(match: np.ndarray, loss: int = LOSS, drop: int = DROP) -> list[tuple[int, int]]:
    """Ranges of columns, each from a match to a match, cut where the score falls by more than ``drop``."""
    if match.all():
        return [(0, len(match))]
    edge = np.flatnonzero(np.diff(match.astype(np.int8))) + 1
    bounds = [0, *edge.tolist(), len(match)]
    out: list[tuple[int, int]] = []
    start, score, best, end = None, 0, 0, 0
    for lo, hi in zip(bounds, bounds[1:]):
        if match[lo]:
            if start is None or score < 0:
                if start is not None:
                    out.append((start, end))
                start, score, best = lo, 0, 0
            score += hi - lo
            if score > best:
                best, end = score, hi
        elif start is not None:
            score -= loss * (hi - lo)
            if best - score > drop:
                out.append((start, end))
                start, score, best = None, 0, 0
    if start is not None:
        out.append((start, end))
    return out


def aligned(found: DataFrame, docs: DataFrame, min_words: int, similarity: float, margin: int | None, id_col: str, text_col: str) -> DataFrame:
    """(chain, open, doc_id, start, stop, source_id, source_start, source_stop, matches, similarity): the passages of chains, and those chains that would go on beyond ``margin`` (open). A written table."""
    side = lambda of, s: found.select(F.col(of).alias("id"), "chain", F.lit(s).alias("side"), F.col(f"lo{s}").alias("lo"), F.col(f"hi{s}").alias("hi"))
    sides = side("x", 0).union(side("y", 1))
    # a document that very many others share a passage with has its sides dealt over several rows
    counts = pinned(sides.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "counts")
    dealt = (
        sides.join(few(counts.where(F.col("n") > SIDES_A_ROW)), "id", "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("chain"), F.ceil(F.col("n") / SIDES_A_ROW)), F.lit(0)))
        .groupBy("id", "part")
        .agg(F.collect_list(F.struct("chain", "side", "lo", "hi")).alias("sides"))
    )
    texts = with_texts(docs, counts.select("id"), id_col, text_col)

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words([text])
                short, n = (w.hash >> np.uint64(32)).astype(np.uint32), len(w.hash)
                out = []
                for s in own.as_py():
                    lo, hi = (0, n) if margin is None else (max(0, s["lo"] - margin), min(n, s["hi"] + margin))
                    out.append((s["chain"], s["side"], lo, lo > 0, hi < n, short[lo:hi].tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["chain", "side", "lo", "less", "more", "hashes"])

    cut = texts.join(dealt, "id").select("text", "sides").mapInArrow(settled(cut_out), "chain long, side int, lo int, less boolean, more boolean, hashes binary")
    both = pinned(cut, "spans")
    one = lambda s: both.where(F.col("side") == s).select("chain", *[F.col(c).alias(f"{c}{s}") for c in ("lo", "less", "more", "hashes")])
    wide = found.select("chain", "x", "y", "frags").join(one(0), "chain").join(one(1), "chain")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows, cores, sides_ = [], [], ([], [], [], [])
                for chain_id, x, y, f, lo0, less0, more0, h0, lo1, less1, more1, h1 in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    frag = np.frombuffer(f, "<i4").reshape(-1, 3).astype(np.int64)
                    a, b = np.frombuffer(h0, np.uint32), np.frombuffer(h1, np.uint32)
                    frag[:, 0] -= lo0
                    frag[:, 1] -= lo1
                    match, p0, p1 = columns(a, b, frag.tolist())
                    cores.append((chain_id, x, y, lo0, lo1, match, p0, p1, less0 + 2 * less1, more0 + 2 * more1))
                    for own, piece in zip(sides_, (a[: p0[0]][::-1], b[: p1[0]][::-1], a[p0[-1] + 1 :], b[p1[-1] + 1 :])):
                        own.append(piece)
                left, right = extend(sides_[0], sides_[1]), extend(sides_[2], sides_[3])
                for i, (chain_id, x, y, lo0, lo1, match, p0, p1, less, more) in enumerate(cores):
                    if (less & int(left[3][i])) | (more & int(right[3][i])):
                        rows.append((chain_id, True, y, 0, 0, x, 0, 0, 0, 0.0))
                        continue
                    for s, e in stretches(match):
                        matches = int(match[s:e].sum())
                        s0, s1, e0, e1 = int(p0[s]), int(p1[s]), int(p0[e - 1]) + 1, int(p1[e - 1]) + 1
                        if s == 0:
                            s0, s1, matches = s0 - int(left[0][i]), s1 - int(left[1][i]), matches + int(left[2][i])
                        if e == len(match):
                            e0, e1, matches = e0 + int(right[0][i]), e1 + int(right[1][i]), matches + int(right[2][i])
                        same = matches / max(e0 - s0, e1 - s1)
                        if same < similarity:  # its best part, if that is long enough
                            part = stretches(match[s:e], loss=4, drop=8)
                            u, v = max(part, key=lambda r: r[1] - r[0])
                            u, v = u + s, v + s
                            matches = int(match[u:v].sum())
                            s0, s1, e0, e1 = int(p0[u]), int(p1[u]), int(p0[v - 1]) + 1, int(p1[v - 1]) + 1
                            same = matches / max(e0 - s0, e1 - s1)
                        if min(e0 - s0, e1 - s1) >= min_words and same >= similarity:
                            rows.append((chain_id, False, y, s1 + lo1, e1 + lo1, x, s0 + lo0, e0 + lo0, matches, same))
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    names = ["chain", "open", "doc_id", "start", "stop", "source_id", "source_start", "source_stop", "matches", "similarity"]
    done = pinned(
        wide.mapInArrow(
            settled(align), "chain long, open boolean, doc_id long, start int, stop int, source_id long, source_start int, source_stop int, matches int, similarity double"
        ),
        "aligned",
    )
    released(docs.sparkSession, counts, texts, both)
    return done


def passages(found: DataFrame, docs: DataFrame, min_words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, stop, source_id, source_start, source_stop, matches, similarity) of the chains that align well enough.

    All chains are aligned with a small margin first, those that go on at its edge with a larger one, and the rest with whole texts.
    """
    out = None
    for margin in MARGINS:
        done = aligned(found, docs, min_words, similarity, margin, id_col, text_col)
        kept = done.where(~F.col("open")).drop("chain", "open")
        out = kept if out is None else out.union(kept)
        still = done.where("open").select("chain").distinct()
        if margin is None or still.isEmpty():
            return out
        found = pinned(found.join(few(still), "chain", "left_semi"), "chains")


def shared_passages(
    docs: DataFrame, k: int = 5, rate: int = 5, spread: int = 10, min_words: int = 50, similarity: float = 0.8, max_gap: int = 40, far: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Passages that a document shares with one of a smaller id: doc_id, start, stop, source_id, source_start, source_stop, matches, similarity.

    start and stop count words (see wordstream) of the whole text; a passage has ``min_words`` words at least in
    both. It is reported against the first documents that have its seeds and keys, and the last one with its seeds before, so a
    passage of n documents gives 2 to 4 n rows, not n squared, and the document of the smallest id is only ever a source.
    Every shared run of ``min_words`` + ``spread`` - 1 words or more is found; shorter and edited ones by their seeds and span keys.
    Null and empty texts and null ids share nothing; repetition within one document isn't reported; of rows with one id
    that with the smallest text counts. Of ties between places of a seed in its document the first counts. Ids are whole
    numbers. No rows from an empty table; other columns aren't read.
    """
    if repeats_ids(docs, id_col):
        docs = docs.groupBy(id_col).agg(F.min(text_col).alias(text_col))
    of = lambda table: seeds(table, k, rate, min_words, spread, id_col, text_col)
    sample = docs.where(F.pmod(F.xxhash64(docs[id_col], F.lit(11)), F.lit(64)) == 0)  # only tells which seeds to deal over several tasks
    drawn = pinned(of(sample), "sample")
    made, links = anchors(of(docs), drawn, min_words)
    found = pinned(chains(links, k, min_words, max_gap, far), "chains")
    released(docs.sparkSession, drawn, made)
    return passages(found, docs, min_words, similarity, id_col, text_col)


_word = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given ranges of words, each with the white space before it."""
    places = [m.span() for m in _word.finditer(text)]
    out, at = [], 0
    for start, stop in sorted(spans):
        start, stop = max(start, 0), min(stop, len(places))
        if start >= stop:
            continue
        lo, hi = places[start][0], places[stop - 1][1]
        if stop < len(places):  # the punctuation after the last word goes with it
            rest = text[hi : places[stop][0]]
            hi += len(rest) - len(rest.lstrip(".,;:!?"))
        else:
            hi = len(text)
        if lo > at:
            out.append(text[at:lo].rstrip() if out or lo else "")
        at = max(at, hi)
    out.append(text[at:])
    return "\n".join(p.strip("\n") for p in out if p.strip())


def cut_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any others) with each repeated passage kept in its first document only.

    ``found`` is shared_passages of ``docs``. A document of which no word is left goes; n_chars is set anew.
    """
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    joined = docs.join(spans, docs["doc_id"] == spans["_id"], "left").drop("_id")
    at, last = joined.columns.index("text"), joined.columns.index("_spans")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            touched = set()
            for i, own in enumerate(batch.column(last)):
                if spans_of := own.as_py():
                    texts[i] = without_spans(texts[i], [(s["start"], s["stop"]) for s in spans_of])
                    touched.add(i)
                keep.append(i not in touched or bool(_word.search(texts[i])))
            cols = list(batch.columns)[:-1]
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                was = batch.column(size).to_pylist()
                cols[size] = pa.array([len(texts[i]) if i in touched else was[i] for i in range(len(texts))], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(settled(run), docs.schema)
