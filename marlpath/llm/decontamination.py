"""Benchmark decontamination: rare word and bigram seeds find training passages, Smith-Waterman alignment scores them.

The result is that of aligning every document with every item, for these bounds let no copy go. An alignment of M
matching words in runs parted by gaps or other words loses 1 at least between two runs, so that M and the
bigrams within its runs are its score less 1 at least: an item of m words has 2m - 1 such features, and a copy
must share ``need`` of them within ``span`` words. However its edits lie, any 2m - 1 - need + k of an item's
features have k in the copy: the seeds are the rarest ones in the corpus.

A benchmark is small beside a corpus, but has no fixed size: it is worked off in blocks of at most ``block_words``
words, which bounds all that is broadcast. For each block:

1. One pass over all documents counts the block's words and bigrams, which orders them by rarity.
2. A second pass finds the seeds, in tiles of 2 * span words that step by span: each copy lies in one tile. Tiles with k
   seeds and ``need`` features of an item are aligned to it. The score is the alignment's, over that of an exact copy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pinned, settled, without_ids
from .wordstream import chunks, shingles, words

MATCH, MISMATCH, GAP = 2, -1, -1
BITS = 22


class Block(NamedTuple):
    """ids, words: of the items, words as 32-bit hashes; features: hashes of all words and bigrams, sorted; of: each item's features; need, span: see above."""

    ids: list
    words: list[np.ndarray]
    features: np.ndarray
    of: list[np.ndarray]
    need: np.ndarray
    span: np.ndarray


class Seeds(NamedTuple):
    """least: seeds that a copy of each item has; item[first[f] : first[f + 1]]: the items that feature f seeds."""

    least: np.ndarray
    first: np.ndarray
    item: np.ndarray


def short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def make_block(items: list[tuple], n: int, threshold: float) -> Block:
    w = words([t for _, t in items])
    size = np.diff(w.first)
    pair, at = shingles(w, 2)
    own = size >= n
    hashes = np.concatenate((w.hash[own[w.doc]], pair[own[w.doc[at]]]))
    item = np.concatenate((w.doc[own[w.doc]], w.doc[at][own[w.doc[at]]]))
    features, back = np.unique(hashes, return_inverse=True)
    of = np.split(back[np.argsort(item, kind="stable")], np.cumsum(np.bincount(item, minlength=len(items)))[:-1])
    score = np.ceil(threshold * MATCH * size - 1e-9).astype(np.int64)
    all_words = short(w.hash)
    return Block([i for i, _ in items], [all_words[w.first[i] : w.first[i + 1]] for i in range(len(items))], features, of, np.maximum(score - 1, 1), np.maximum(3 * size - score, 1))


def blocks(benchmark: DataFrame, n: int, threshold: float, block_words: int, id_col: str, text_col: str) -> Iterator[Block]:
    """The items as blocks of at most ``block_words`` words (a longer item alone), streamed through the driver a block at a time."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        count = len(row[1]) // 2 + 1
        if held and size + count > block_words:
            yield make_block(held, n, threshold)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += count
    if held:
        yield make_block(held, n, threshold)


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, where in the passage it ends) of each pair, all pairs at once row by row.

    With a linear gap cost the gaps within a row are a running maximum, so that a row takes a few vector operations.
    """
    m, width = max(map(len, items)), max(map(len, passages))
    rows = np.zeros((len(items), m), np.int64)
    cols = np.full((len(items), width), -1, np.int64)
    for i, (a, b) in enumerate(zip(items, passages)):
        rows[i, : len(a)] = a
        rows[i, len(a) :] = -2
        cols[i, : len(b)] = b
    now = np.zeros((len(items), width + 1), np.int32)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for r in range(m):
        new = now + np.int32(GAP)
        new[:, 1:] = np.maximum(new[:, 1:], now[:, :-1] + np.where(cols == rows[:, r : r + 1], np.int32(MATCH), np.int32(MISMATCH)))
        np.maximum(new, 0, out=new)
        now = np.maximum.accumulate(new + slope, axis=1) - slope
        top = now.max(axis=1)
        better = top > best
        if better.any():
            best[better] = top[better]
            end[better] = now[better].argmax(axis=1)
    return best, end


def flags(features: np.ndarray) -> np.ndarray:
    flag = np.zeros(1 << BITS, bool)
    flag[(features >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return flag


def located(features: np.ndarray, flag: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The index in ``features`` of each hash, -1 for others."""
    found = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(flag[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    f = np.searchsorted(features, h[maybe])
    f[f == len(features)] = 0
    same = features[f] == h[maybe]
    found[maybe[same]] = f[same]
    return found


def feature_counts(docs: DataFrame, held, text_col: str) -> list[np.ndarray]:
    """Occurrences of each feature of the blocks in the corpus, in one scan for all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.features, flags(b.features), np.zeros(len(b.features), np.int64)) for b in held.value]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                w = words(texts[lo:hi])
                for h in (w.hash, shingles(w, 2)[0]):
                    for features, flag, total in own:
                        f = located(features, flag, h)
                        total += np.bincount(f[f >= 0], minlength=len(features))
        for i, (_, _, total) in enumerate(own):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some), pa.array(total[some])], ["block", "feature", "n"])

    counted = docs.select(docs[text_col].alias("t")).mapInArrow(settled(run), "block int, feature long, n long").groupBy("block", "feature").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most the blocks' features
    block, feature, n = (found.column(c).to_numpy() for c in ("block", "feature", "n"))
    out = [np.zeros(len(b.features), np.int64) for b in held.value]
    for i, total in enumerate(out):
        total[feature[block == i]] = n[block == i]
    return out


def rare_seeds(block: Block, counts: np.ndarray, most: int = 3) -> Seeds:
    """Of each item the rarest features, so many that any copy has ``most`` of them (or all it needs)."""
    least = np.minimum(block.need, most)
    pairs = []
    for i, own in enumerate(block.of):
        if len(own):
            rare = own[np.argsort(counts[own], kind="stable")][: len(own) - block.need[i] + least[i]]
            pairs.append(np.stack((np.unique(rare), np.full(len(np.unique(rare)), i))))
    feature, item = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    order = np.argsort(feature, kind="stable")
    return Seeds(least, np.searchsorted(feature[order], np.arange(len(block.features) + 1)), item[order])


def tiles(own: Block, seeds: Seeds, w, word: np.ndarray, pair: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item, first, last) of all tiles that can hold a copy; ``word`` and ``pair``: the feature at each word, or -1."""
    feature, place = np.concatenate((word, pair)), np.tile(np.arange(len(word)), 2)
    width = np.where(feature >= 0, seeds.first[feature + 1] - seeds.first[feature], 0)
    hit = np.flatnonzero(width)
    if not len(hit):
        return
    wide = width[hit]
    item = seeds.item[np.repeat(seeds.first[feature[hit]] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())]
    place = np.repeat(place[hit], wide)
    doc = w.doc[place]
    tile = (place - w.first[doc]) // own.span[item]
    more, items = int(tile.max()) + 1, len(own.ids)
    key = (doc * items + item) * more + tile
    key, count = np.unique(np.concatenate((key, key[tile > 0] - 1)), return_counts=True)
    pairing, tile = np.divmod(key, more)
    doc, item = np.divmod(pairing, items)
    seen = np.zeros(len(own.features) + 1, bool)
    for k in np.flatnonzero(count >= seeds.least[item]).tolist():
        d, i, first = int(doc[k]), int(item[k]), int(w.first[doc[k]] + tile[k] * own.span[item[k]])
        last = int(min(first + 2 * own.span[i], w.first[d + 1]))
        seen[word[first:last]] = seen[pair[first : last - 1]] = True
        seen[-1] = False
        if np.count_nonzero(seen[own.of[i]]) >= own.need[i]:
            yield d, i, first, last
        seen[word[first:last]] = seen[pair[first : last - 1]] = False


def copies_of(own: Block, rare: Seeds, flag: np.ndarray, w, h: np.ndarray, at: np.ndarray, code: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(doc, item, score, start, stop) of the tiles of some texts that align with an item of one block; ``h``, ``at``: the texts' bigrams, ``code``: their words."""
    word, pair = located(own.features, flag, w.hash), np.full(len(w.hash), -1, np.int64)
    pair[at] = located(own.features, flag, h)
    todo = sorted(tiles(own, rare, w, word, pair), key=lambda t: (t[3] - t[2], len(own.words[t[1]])))
    rows, now = [], 0
    while now < len(todo):  # pairs of like length together, so that little is padded
        part = todo[now : now + max(1, min(256, 400_000 // (todo[now][3] - todo[now][2])))]
        text = [code[a:b] for _, _, a, b in part]
        best, end = smith_waterman([own.words[t[1]] for t in part], text)
        good = [j for j, t in enumerate(part) if best[j] >= threshold * MATCH * len(own.words[t[1]])]
        if good:
            _, back = smith_waterman([own.words[part[j][1]][::-1] for j in good], [text[j][: end[j]][::-1] for j in good])
            for j, b in zip(good, back):
                d, i, first, _ = part[j]
                stop = int(first - w.first[d] + end[j])
                rows.append((d, i, float(best[j]) / (MATCH * len(own.words[i])), stop - int(b), stop))
        now += len(part)
    return rows


def aligned(docs: DataFrame, held, seeds, threshold: float, id_col: str, text_col: str, item_type: str) -> DataFrame:
    """(id, item_id, score, start, stop) of tiles that align with an item at ``threshold`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_ = [(own, rare, flags(own.features)) for own, rare in zip(held.value, seeds.value)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                w = words(texts[lo:hi])
                h, at = shingles(w, 2)
                code = short(w.hash)
                for own, rare, flag in blocks_:
                    rows = copies_of(own, rare, flag, w, h, at, code, threshold)
                    if not rows:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([r[0] + lo for r in rows], pa.int64())), pa.array([own.ids[r[1]] for r in rows], pa.int64() if item_type == "bigint" else None),
                            pa.array([r[2] for r in rows], pa.float64()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4)],
                        ],
                        ["id", "item_id", "score", "start", "stop"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(settled(run), f"id {kind}, item_id {item_type}, score double, start long, stop long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 4,
    threshold: float = 0.5,
    block_words: int = 200_000,
    blocks_a_scan: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The best passage of each document for each item it holds a copy of: doc_id, item_id, score, start, stop.

    score is the alignment's score over an exact copy's (1: exact), with 2 for a matching word, -1 for another one
    and -1 for one left out or put in; start and stop count words of the document. Items of fewer than ``n`` words,
    null and empty texts match nothing. Repeated rows of one id give its best passage; a null id is reported as
    null. An empty table on either side gives no rows. Columns other than ids and texts aren't read. The corpus is read
    twice for each ``blocks_a_scan`` blocks of ``block_words`` words, which tasks hold together.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"id {id_type}, item_id {item_type}, score double, start long, stop long")
    with_features = (own for own in blocks(benchmark, n, threshold, block_words, "item_id", "text") if len(own.features))
    while some := list(islice(with_features, blocks_a_scan)):
        held = spark.sparkContext.broadcast(some)
        seeds = spark.sparkContext.broadcast([rare_seeds(own, n) for own, n in zip(some, feature_counts(docs, held, text_col))])
        result = result.union(pinned(aligned(docs, held, seeds, threshold, id_col, text_col, item_type), "copies"))
    best = result.groupBy("id", "item_id").agg(F.max(F.struct("score", -F.col("start"), "stop")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.score", (-F.col("b.col2")).alias("start"), "b.stop")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold a copy of no item; rows with null ids are kept, as they can't be named."""
    return without_ids(docs, contaminated(docs, benchmark, **options).select("doc_id").distinct())
