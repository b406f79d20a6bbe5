"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes, reranked by exact distance.

1. On a bounded sample rotations are learned (principal axes, then alternating sign codes and orthogonal fits) that
   make signs of rotated vectors good codes; several rotations from different starts give more bits than dimensions.
2. A code is split into ``substrings`` of 16 bits. Each row is entered once for each substring, under that substring's
   leading bits (its address); entries of one address are dealt over blocks of bounded size.
3. Two codes within ``radius`` bits agree within ``radius // substrings`` bits in one substring at least. A query asks
   the addresses within so many bits of its own for each substring, and there the substrings within as many: every code
   in the radius is met, and it is reranked only at the first substring in which it comes near.
4. Each block answers with a query's nearest few by distance. Queries with too few neighbours ask again with a larger
   radius, at last with one that takes in every code.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import keyed, matrix, meet, parts_of, sampled, usable_vectors
from .frames import few, pinned

WIDTH = 16


class Coder:
    """Centre and rotations; ``codes`` gives each vector's bits, packed into 16-bit substrings."""

    def __init__(self, sample: np.ndarray, bits: int, turns: int = 25, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        _, _, axes = np.linalg.svd(x.T @ x)
        found: list[np.ndarray] = []
        while sum(r.shape[1] for r in found) < bits:
            own = axes[: min(bits, len(axes))].T
            turn = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))[0]
            v = x @ own
            for _ in range(turns):
                left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
                turn = left @ right
            found.append(own @ turn)
        self.rotation = np.concatenate(found, axis=1)[:, :bits]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.centre) @ self.rotation >= 0, axis=1).view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def radius_for(coder: Coder, sample: np.ndarray, k: int, share: float, queries: int = 256) -> int:
    """The Hamming radius within which ``share`` of the sample's own ``k`` nearest neighbours lie, from some of its vectors."""
    codes = coder.codes(sample).view("<u8")
    got = []
    for i in range(min(queries, len(sample))):
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        got.append(np.bitwise_count(codes[near] ^ codes[i]).sum(axis=1, dtype=np.int64))
    all_ = np.concatenate(got) if got else np.zeros(0, np.int64)
    return int(math.ceil(np.quantile(all_, share))) if len(all_) else 0


def nearest_of(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest scores of each of ``who``, ties to smaller ids."""
    order = np.lexsort((ids, score, who))
    own = who[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - start < k]


class Block:
    """Entries of one address of one substring, with a directory of the distinct substrings."""

    def __init__(self, substring: int, rows: pa.RecordBatch, radius: int, k: int):
        self.s, self.radius, self.k = substring, radius, k
        self.ids = rows.column("id").to_numpy()
        self.codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u2").reshape(len(self.ids), -1)
        self.vectors = matrix(rows.column("vec"))
        self.near = radius // self.codes.shape[1]
        self.directory, self.entry = np.unique(self.codes[:, substring], return_inverse=True)

    def __call__(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(asked), 64):
            rows = asked.slice(lo, 64)
            ids = rows.column("id").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u2").reshape(len(ids), -1)
            vectors = matrix(rows.column("vec"))
            probed = np.bitwise_count(codes[:, self.s, None] ^ self.directory[None, :]) <= self.near
            q, e = np.nonzero(probed[:, self.entry] & (ids[:, None] != self.ids[None, :]))
            apart = np.bitwise_count(codes[q] ^ self.codes[e])
            own = (apart.sum(axis=1, dtype=np.int64) <= self.radius) & ((apart <= self.near).argmax(axis=1) == self.s)
            q, e = q[own], e[own]
            score = np.concatenate([distances(vectors[q[i : i + 8192]], self.vectors[e[i : i + 8192]]) for i in range(0, len(q), 8192)] or [np.zeros(0)])
            best = nearest_of(ids[q], self.ids[e], score, self.k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[best]]), pa.array(self.ids[e[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def coded(vectors: DataFrame, coder) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = coder.value.codes(matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    return vectors.mapInArrow(run, f"id long, vec {vectors.schema['vec'].dataType.simpleString()}, code binary")


def entries(coded_: DataFrame, substrings: int, address: int) -> DataFrame:
    """A row for each substring: s, its leading ``address`` bits (top), id, code, vec."""
    at = lambda s: F.expr(f"cast(conv(hex(substring(code, {2 * s + 2}, 1)), 16, 10) as int) * 256 + cast(conv(hex(substring(code, {2 * s + 1}, 1)), 16, 10) as int)")
    places = F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright(at(s), WIDTH - address).alias("top")) for s in range(substrings)])
    return coded_.withColumn("e", F.explode(places)).select("e.s", "e.top", "id", "code", "vec")


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 128, share: float = 0.98, sample: int = 20_000, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` nearest rows found by Euclidean distance: query_id, rank (from 1), vec_id, score.

    ``queries`` (one id column) names rows of ``rows``. Codes have ``bits`` bits, a multiple of 64; rotations are
    learned on at most ``sample`` vectors, and every row is indexed. The radius is that within which ``share`` of the sample's neighbours lie:
    among all rows neighbours are nearer still. Queries with fewer than ``k`` neighbours there ask again with half as
    much more, at last of every row, so each gets ``k`` (all, if fewer).

    Vectors null, zero, of another length than most, or with null or non-finite components take no part, nor do
    rows without an id; of rows with one id one stays. Ties go to the smaller id. Equal vectors share addresses, whose
    entries are dealt over blocks of ``block`` rows, so none grows with them. Other columns aren't read; no rows from
    an empty table.
    """
    spark, substrings = rows.sparkSession, bits // WIDTH
    vectors = usable_vectors(rows, id_col, vec_col, zero=False)
    total = vectors.count()
    if total == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    learned = sampled(vectors, sample)
    coder = Coder(learned, bits)
    radius = radius_for(coder, learned, k, share)
    stored = pinned(coded(vectors, spark.sparkContext.broadcast(coder)), "codes")
    address = min(WIDTH, max(0, math.ceil(math.log2(total / block))))
    index = entries(stored, substrings, address)
    sizes = pinned(parts_of(index.groupBy("s", "top").agg(F.count(F.lit(1)).alias("n")), block), "sizes")
    held = keyed(index, sizes, ["s", "top"], F.xxhash64("id")).select("s", "top", "part", "id", "code", "vec")
    wanted = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    asking = stored.join(few(pinned(wanted, "queries")), "id", "left_semi")
    found = None
    while True:
        near = radius // substrings
        probes = entries(asking, substrings if near < WIDTH else 1, address)
        ball = F.filter(F.sequence(F.lit(0), F.lit((1 << address) - 1)), lambda m: F.bit_count(m) <= near)
        probes = probes.withColumn("m", F.explode(ball)).withColumn("top", F.col("top").bitwiseXOR(F.col("m"))).drop("m")
        asked = probes.join(sizes, ["s", "top"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("s", "top", "part", "id", "code", "vec")
        opened = lambda key, batch, radius=radius: Block(key[0], batch, radius, k)
        got = pinned(meet(held if near < WIDTH else held.where("s = 0"), asked, ["s", "top", "part"], opened, "query_id long, vec_id long, score double"), "neighbours")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
        got = pinned(got.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
        enough = got.where(F.col("rank") == min(k, total - 1)).select(F.col("query_id").alias("id"))
        kept = got.join(few(enough.withColumnRenamed("id", "query_id")), "query_id", "left_semi")
        found = kept if found is None else found.union(kept)
        asking = pinned(asking.join(few(enough), "id", "left_anti"), "asking")
        if total == 1 or radius >= bits or asking.isEmpty():
            return found.select("query_id", "rank", "vec_id", "score")
        radius = min(bits, radius + max(substrings, radius // 2))
