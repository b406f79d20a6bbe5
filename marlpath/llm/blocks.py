"""Blocks of bounded size that are held in a task, while what is asked of them streams by."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import few, pinned


def parts_of(sizes: DataFrame, most: int) -> DataFrame:
    """``sizes`` (keys and n) with ``parts`` in place of n: in how many blocks of about ``most`` rows a key's rows are dealt."""
    return sizes.withColumn("parts", F.ceil(F.col("n") / most).cast("int")).drop("n")


def meet(
    held: DataFrame, asked: DataFrame, keys: list[str], opened: Callable[[tuple, pa.RecordBatch], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str
) -> DataFrame:
    """For each block, named by whole-number ``keys``: ``opened(key, its held rows)`` makes what answers the rows asked of it.

    Both tables have the same columns. A task keeps the held rows of one block at a time, so a block's size bounds its
    memory; the rows that ask follow them in the sort order and stream by, however many there are. Blocks without
    held rows or without questions answer nothing.
    """
    both = held.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)))
    names = [*keys, "_side"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, answer = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            cut = (np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
                key, side = tuple(marks[:-1, lo].tolist()), marks[-1, lo]
                if key != now:
                    now, rows, answer = key, [], None
                if side == 0:
                    rows.append(batch.slice(lo, hi - lo))
                elif rows:
                    if answer is None:
                        answer = opened(key, pa.Table.from_batches(rows).combine_chunks().to_batches(max_chunksize=1 << 30)[0])
                    yield from answer(batch.slice(lo, hi - lo))

    return both.repartition(*keys).sortWithinPartitions(*names).mapInArrow(run, schema)


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of number lists of one length as a matrix, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, zero: bool, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, vec, and the columns of ``more``): the rows whose vector is neither null nor holds a null or non-finite component.

    Zero vectors stay where ``zero`` is true. Rows without an id take no part, nor do vectors of another length
    than the most frequent one (of ties the longest). Of rows with one id that with the smallest vector stays.
    """
    good = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vec_col) > 0)
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    found = rows.where(good & fine)
    if not zero:
        found = found.where(F.exists(vec_col, lambda x: x != 0))
    found = found.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), *[c.alias(n) for n, c in (more or {}).items()])
    lengths = found.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    top = lengths.agg(F.max(F.struct("rows", "n")).alias("top"), F.count(F.lit(1)).alias("kinds")).first()
    if top["kinds"] > 1:
        found = found.where(F.size("vec") == top["top"]["n"])
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        found = found.groupBy("id").agg(F.min(F.struct(*[c for c in found.columns if c != "id"])).alias("r")).select("id", "r.*")
    return pinned(found, "vectors")


def sampled(vectors: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the least hashed ids: a bounded sample that is the same on every run."""
    table = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toArrow()
    return matrix(table.column("vec").combine_chunks())


def keyed(rows: DataFrame, sizes: DataFrame, keys: list[str], turn: Column) -> DataFrame:
    """``rows`` with ``part``: the block of its key to which ``turn`` deals it."""
    return rows.join(few(sizes), keys).withColumn("part", F.pmod(turn, F.col("parts")).cast("int")).drop("parts")
