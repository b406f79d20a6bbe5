"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

1. Document frequencies of all shingles, counted over all documents in 2**21 cells by the hashing trick: bounded
   at any corpus size, and a frequent shingle stands out of its cell at any size.
2. Each document's shingles weigh tf * (1 + ln((1 + N) / (1 + df))). Improved consistent weighted sampling draws
   ``bands * rows`` samples (shingle, quantised weight); two documents agree in one with the probability of their
   weighted Jaccard similarity. Those that agree in all samples of a band share a bucket.
3. Documents with equal texts are one from here on. Each member of a bucket is verified against the bucket's first
   by the exact weighted Jaccard similarity of their whole texts, which joins most of a large group: a linear number
   of pairs.
4. In each bucket that still holds several classes, all pairs of different class are verified, where their members
   meet: no pair leaves its task but the links. A bucket is cut into parts of bounded size that all meet, and a pair
   is looked at only in the first band that it shares. Classes are the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import few, pinned, released, settled, shuffle_width, without_ids
from .wordstream import chunks, mix, shingles, words

CELLS = 1 << 21
SLICE = 1 << 16


def shingle_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, distinct shingle hashes, counts) of each text with a word. A text of fewer than n words is one shingle of all of them."""
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi])
        h, at = shingles(w, n)
        cut = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
        size = np.diff(w.first)
        for i in range(hi - lo):
            if size[i] >= n:
                yield lo + i, *np.unique(h[cut[i] : cut[i + 1]], return_counts=True)
            elif size[i]:
                whole = blake2b(w.hash[w.first[i] : w.first[i + 1]].tobytes(), digest_size=8).digest()
                yield lo + i, np.frombuffer(whole, np.uint64), np.ones(1, np.int64)


def cell_frequencies(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """For each of CELLS hash cells, in how many (document, distinct shingle) pairs of the corpus it occurs.

    Each task sums its documents in one vector and hands it on in slices; slices are summed by slice, first for groups
    of tasks (the root of the shuffle's width, 16 at least) and then over these, so no task holds more than one
    vector, and the driver gets one.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, h, _ in shingle_sets(batch.column(0).to_pylist(), n):
                np.add.at(cells, (h >> np.uint64(43)).astype(np.int64), 1)
        for i in range(0, CELLS, SLICE):
            part = cells[i : i + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "cells"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(part, np.int64)
                total[i] = total[i] + got if i in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "cells"])

    kind = "slice int, cells binary"
    parts = docs.select(F.col(text_col)).mapInArrow(settled(count), kind)
    groups = max(16, math.isqrt(shuffle_width(docs.sparkSession)))
    parts = parts.withColumn("_s", F.spark_partition_id() % groups).repartition(4 * groups, "slice", "_s").drop("_s").mapInArrow(settled(merge), kind)
    parts = parts.repartition(CELLS // SLICE, "slice").mapInArrow(settled(merge), kind)
    cells = np.zeros(CELLS, np.int64)
    for row in parts.collect():  # at most CELLS / SLICE rows, CELLS numbers
        cells[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["cells"], np.int64)
    return cells


def cell_weights(cells: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log((1.0 + n_docs) / (1.0 + np.minimum(cells, n_docs)))).astype(np.float32)


def weigh(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf.astype(np.float32) * idf[(h >> np.uint64(43)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def icws(h: np.ndarray, log_weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Sample ``k`` of each document: documents are the runs of ``h`` that begin at ``first``.

    r and c are Gamma(2, 1) and b is uniform, all drawn from the shingle's hash; t = floor(ln w / r + b). The sample
    is the shingle that minimises ln c - r (t - b) - r, with its t; both go into one 64-bit value.
    """
    x = mix(h ^ np.uint64(((2 * k + 1) * 0xA24BAED4963EE407) & (2**64 - 1)))
    y = mix(x + np.uint64(0x9FB21C651E98DF25))
    unit = lambda v, shift, bits: ((v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32)
    r = -np.log((unit(x, 0, 20) + 0.5) * (unit(x, 20, 20) + 0.5) * np.float32(2.0**-40))
    b = unit(x, 40, 24) * np.float32(2.0**-24)
    c = -np.log((unit(y, 0, 32) + 0.5) * (unit(y, 32, 32) + 0.5) * np.float32(2.0**-64))
    t = np.floor(log_weight / r + b)
    score = np.log(np.maximum(c, np.float32(1e-12))) - r * (t - b) - r
    bits = score.view(np.int32)
    key = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
    least = np.minimum.reduceat((key << 31) + np.arange(len(h), dtype=np.int64) % (1 << 31), first)
    at = least & ((1 << 31) - 1)
    return mix(h[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def signatures(docs: DataFrame, n: int, idf, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, digest of its text, band_keys (null without words), the same as bytes, and its number of shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            digest = [sha256(t.encode()).digest()[:16] for t in texts]
            keys, joined, size = [None] * len(texts), [None] * len(texts), [0] * len(texts)
            group: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush(group=group, keys=keys, joined=joined, size=size) -> None:
                h = np.concatenate([g[1] for g in group])
                first = np.cumsum([0] + [len(g[1]) for g in group[:-1]])
                log_weight = np.log(weigh(h, np.concatenate([g[2] for g in group]), weights))
                sig = np.stack([icws(h, log_weight, first, k) for k in range(bands * rows)], axis=1)
                band = sig.reshape(len(group), bands, rows)
                key = band[:, :, 0].copy()
                for j in range(1, rows):
                    key = mix(key * np.uint64(0xD1342543DE82EF95) + band[:, :, j])
                for g, k in zip(group, key.view(np.int64)):
                    keys[g[0]], joined[g[0]], size[g[0]] = k.tolist(), k.astype("<i8").tobytes(), len(g[1])
                group.clear()

            held = 0
            for g in shingle_sets(texts, n):
                group.append(g)
                held += len(g[1])
                if held > 60_000:
                    flush()
                    held = 0
            if group:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(joined, pa.binary()), pa.array(size, pa.int64())],
                ["id", "digest", "band_keys", "bands", "size"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("_t")).mapInArrow(
        settled(run), f"id {kind}, digest binary, band_keys array<bigint>, bands binary, size long"
    )


def bucket_members(reps: DataFrame) -> DataFrame:
    """(band, key, id, bands, size, lead) of the documents in buckets of two at least; lead is the bucket's least id."""
    rows = reps.where("band_keys is not null").select("id", "bands", "size", F.posexplode("band_keys").alias("band", "key"))
    leads = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1").drop("n")
    return rows.join(leads, ["band", "key"])


def open_buckets(members: DataFrame, labels: DataFrame, part_size: int) -> DataFrame:
    """The rows of buckets with several labels, once for each meeting (i, j) of parts: band, key, i, j, side, id, label, main, bands.

    ``main`` is the bucket's most frequent label; its members needn't meet one another. A bucket of at most
    ``part_size`` shingles is one part; in a larger one the members of the main label and the others are dealt over
    parts of that size each, and every part of others meets every part.
    """
    known = members.join(labels, "id")
    counts = known.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    buckets = (
        counts.groupBy("band", "key")
        .agg(F.count(F.lit(1)).alias("labels"), F.max_by(F.struct("label", "size"), F.struct("n", "label")).alias("m"), F.sum("size").alias("all"))
        .where("labels > 1")
        .select(
            "band", "key", F.col("m.label").alias("main"), (F.col("all") <= part_size).alias("one"),
            F.ceil((F.col("all") - F.col("m.size")) / part_size).cast("int").alias("others"), F.ceil(F.col("m.size") / part_size).cast("int").alias("mains"),
        )
    )
    rows, of_main = known.join(buckets, ["band", "key"]), F.col("label") == F.col("main")
    turn = F.xxhash64("id")
    own = F.when(F.col("one"), 0).when(of_main, F.col("others") + F.pmod(turn, "mains")).otherwise(F.pmod(turn, "others")).cast("int")
    last = F.when(F.col("one"), 0).when(of_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    met = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return met.select(
        "band", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"), "id", "label", "main", "bands",
    )


class Postings:
    """Which of some documents hold a shingle, and how often: all their similarities with another document at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.idf = idf
        size = [len(h) for h, _ in sets]
        h = np.concatenate([s[0] for s in sets])
        order = np.argsort(h, kind="stable")
        self.doc = np.repeat(np.arange(len(sets)), size)[order]
        self.tf = np.concatenate([s[1] for s in sets])[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.total = np.array([float(weigh(x, tf, idf).sum(dtype=np.float64)) for x, tf in sets])

    def similarities(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        own = np.flatnonzero(self.hash[at] == h)
        at = at[own]
        n = self.last[at] - self.first[at]
        place = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        least = np.minimum(self.tf[place], np.repeat(tf[own], n)) * np.repeat(weigh(h[own], np.ones(len(own)), self.idf).astype(np.float64), n)
        both = np.bincount(self.doc[place], least, minlength=len(self.total))
        return both / (self.total + float(weigh(h, tf, self.idf).sum(dtype=np.float64)) - both)


class Meeting:
    """Two parts of one bucket: the held documents, and those that are compared with all held ones of another label."""

    def __init__(self, band: int, main: int, alone: bool, idf: np.ndarray, threshold: float):
        self.band, self.main, self.alone, self.idf, self.threshold = band, main, alone, idf, threshold
        self.rows: list[tuple] = []
        self.index: Postings | None = None
        self.links: list[tuple[int, int, float]] = []
        self.root: dict[int, int] = {}

    def close(self) -> None:
        """No more held documents. Those of the main label are only compared, as they needn't meet one another."""
        held = [r for r in self.rows if r[1] != self.main]
        if held:
            self.index = Postings([r[3] for r in held], self.idf)
            self.ids, self.labels = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            self.keys = np.stack([np.frombuffer(r[2], "<i8") for r in held])

    def compare(self, doc: int, label: int, bands: bytes, own: tuple[np.ndarray, np.ndarray], before: int | None = None) -> None:
        if self.index is None:
            return
        while label in self.root:
            label = self.root[label]
        keys = np.frombuffer(bands, "<i8")
        met = (self.keys[:, : self.band] == keys[: self.band]).any(axis=1)
        wanted = (self.labels != label) & ~met
        if before is not None:
            wanted[before:] = False
        if not wanted.any():
            return
        same = self.index.similarities(*own)
        near = np.flatnonzero(wanted & (same >= self.threshold))
        for k in near.tolist():
            was = int(self.labels[k])
            if was != label:
                self.links.append((min(doc, int(self.ids[k])), max(doc, int(self.ids[k])), float(same[k])))
                self.root[was] = label
                self.labels[self.labels == was] = label

    def finish(self) -> list[tuple[int, int, float]]:
        """Compares a part that is alone with itself."""
        if self.alone:
            self.close()
            place = 0
            for doc, label, bands, own in self.rows:
                self.compare(doc, label, bands, own, None if label == self.main else place)
                place += label != self.main
        return self.links


def bucket_links(meetings: DataFrame, texts: DataFrame, n: int, idf, threshold: float) -> DataFrame:
    """Distinct links (a, b, similarity), similar by ``threshold``, between documents of different label in one bucket.

    Each meeting is one task's: it holds the shingles of one part, of bounded size, while the other streams by.
    Documents that its links have joined already aren't compared again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, now, meeting = idf.value, None, None

        def out(links):
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], t) for k, t in enumerate(kinds)], ["a", "b", "similarity"])

        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for lo in range(0, len(batch), 256):
                rows = batch.slice(lo, 256)
                sets = {k: (h, tf) for k, h, tf in shingle_sets(rows.column(9).to_pylist(), n)}
                for k, (band, key, i, j, side, doc, label, main, bands) in enumerate(zip(*(c.to_pylist() for c in rows.columns[:9]))):
                    if (band, key, i, j) != now:
                        found += meeting.finish() if meeting else []
                        now, meeting = (band, key, i, j), Meeting(band, main, i == j, weights, threshold)
                    if side == 0:
                        meeting.rows.append((doc, label, bands, sets[k]))
                        continue
                    if meeting.rows:
                        meeting.close()
                        meeting.rows = []
                    meeting.compare(doc, label, bands, sets[k])
            yield out(found)
        if meeting:
            yield out(meeting.finish())

    tasks = meetings.join(texts, "id").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "side", "id")
    return tasks.select("band", "key", "i", "j", "side", "id", "label", "main", "bands", "text").mapInArrow(settled(run), "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def with_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is one of ``ids`` (distinct): these are broadcast if they are few, else a shuffled join.

    A written table, so that joins with it are plain ones, which adaptive skew handling splits.
    """
    found = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return pinned(found.join(few(ids), "id", "left_semi"), "texts")


def repeats_ids(rows: DataFrame, id_col: str = "id") -> bool:
    return not rows.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def numbered_texts(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``reps`` (digest, id, ...) and ``docs`` with an id for each different text, and the links (a, b) between those of one row's id.

    Only for tables in which rows of one id have different texts: the least text digest of an id keeps it, the others get
    unused ids above all.
    """
    turn = F.row_number().over(Window.partitionBy("id").orderBy("digest"))
    most = reps.agg(F.max("id")).first()[0]
    ranked = pinned(reps.withColumn("turn", turn).withColumn("n", F.monotonically_increasing_id()), "numbered")
    new = pinned(ranked.withColumn("was", F.col("id")).withColumn("id", F.when(F.col("turn") == 1, F.col("id")).otherwise(F.lit(most + 1) + F.col("n"))), "numbered")
    own = docs.withColumn("_digest", F.substring(F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)), 1, 16)).drop(id_col)
    texts = own.join(new.select(F.col("digest").alias("_digest"), F.col("id").alias(id_col)), "_digest").dropDuplicates(["_digest"]).drop("_digest")
    return new.drop("turn", "n", "was"), texts, new.where("turn > 1").select(F.col("was").alias("a"), F.col("id").alias("b"))


def verified_links(pairs: DataFrame, texts: DataFrame, n: int, idf, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact weighted Jaccard similarity is at least ``threshold``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            same: list[float] = []
            for lo in range(0, len(a), 200):
                part = batch.slice(lo, 200)
                sets = {i: (h, weigh(h, tf, weights)) for i, h, tf in shingle_sets(part.column(2).to_pylist() + part.column(3).to_pylist(), n)}
                same += [weighted_jaccard(sets[i], sets[i + len(part)]) for i in range(len(part))]
            keep = [i for i, s in enumerate(same) if s >= threshold]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([same[i] for i in keep], pa.float64())],
                ["a", "b", "similarity"],
            )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(settled(run), "a long, b long, similarity double")


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    bands: int = 10,
    rows: int = 3,
    part_size: int = 1 << 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, class_id (the least id of its class), is_first (it is that one), n_links, similarity.

    Links are copies of equal text, each to the least id with it, and the verified pairs that joined classes: n_links counts a
    document's own, and similarity is the largest of theirs (null without any). Null texts are empty; equal texts are
    always one class, so all empty texts are. A text without words is like its equals only. Rows with one id are one document
    in whatever order they stand: all its texts count. A null id is a class of its own, with null class_id, is_first true and no
    links. Ids are integers. An empty table gives no rows; other columns aren't read.
    All pairs of a bucket are compared, whatever its size, so that what is missed shares none: a pair of similarity
    s shares a bucket with probability 1 - (1 - s**rows)**bands: 0.9992 at 0.8. ``part_size`` bounds a task's memory.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    idf = spark.sparkContext.broadcast(cell_weights(cell_frequencies(docs, n, text_col), n_docs))
    signed = pinned(signatures(docs.withColumn(id_col, docs[id_col].cast("long")), n, idf, bands, rows, id_col, text_col), "signed")
    reps = signed.where("id is not null").groupBy("digest").agg(F.min(F.struct("id", "band_keys", "bands", "size")).alias("r")).select("digest", "r.*")
    reps = pinned(reps, "reps")
    copies = signed.join(reps.select("digest", F.col("id").alias("a")), "digest").where("id <> a").select("a", F.col("id").alias("b"))
    nodes, texts_of, own, same_row = signed.select("id"), docs, copies, None
    if repeats_ids(reps):
        reps, texts_of, same_row = numbered_texts(docs, reps, id_col, text_col)
        nodes, own = nodes.union(reps.select("id")), copies.union(same_row)
    members = pinned(bucket_members(reps), "members")
    pairs = pinned(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    texts = with_texts(texts_of, members.select("id").distinct(), id_col, text_col)
    links = pinned(verified_links(pairs, texts, n, idf, threshold), "verified")
    labels = components(members.select("id"), links).withColumnRenamed("class_id", "label")
    meetings = open_buckets(members, pinned(labels, "labels"), part_size)
    rest = pinned(bucket_links(meetings, texts, n, idf, threshold), "rest")
    released(spark, members, pairs, texts)
    classes = pinned(components(nodes, own.union(links.select("a", "b")).union(rest.select("a", "b"))), "classes")
    linked = copies.distinct().withColumn("similarity", F.lit(1.0)).union(links).union(rest)
    ends = linked.select(F.explode(F.array("a", "b")).alias("id"), "similarity")
    if same_row is not None:
        ends = ends.join(same_row.select(F.col("b").alias("id"), F.col("a").alias("row_id")), "id", "left").select(F.coalesce("row_id", "id").alias("id"), "similarity")
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("similarity"))
    return (
        signed.select("id").join(classes, "id", "left").join(counts, "id", "left")
        .select(
            F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("is_first"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "similarity",
        )
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that are the first of their class, one row for each id (that of the smallest text); rows with null ids all stay."""
    rest = near_duplicates(docs, **options).where(~F.col("is_first")).select("doc_id").distinct()
    found = without_ids(docs, rest)
    if not repeats_ids(found, "doc_id"):
        return found
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*found.columns)))
    return found.withColumn("_turn", F.when(F.col("doc_id").isNull(), 1).otherwise(turn)).where("_turn = 1").drop("_turn")
