"""Helpers on DataFrames that several operators share: lineage cuts in the shared folder and gapless ranks."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; a session without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, when the session is made, to a folder that the driver and all executors share")
    return folder.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is already gone; the folder stays for its owner's clean-up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def pinned(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: later jobs neither recompute it nor lose it with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of pinned tables that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        _forget(spark, path)


def settled(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker, which lives on between tasks, gives the memory that it freed back to the machine."""

    def until_done(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others give it back themselves
            if trim:
                trim(0)

    return until_done


def few(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """``keys`` (one integer column), marked for a broadcast if they are at most ``most`` rows (about 12 MB as a hash table)."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, … within ``keys`` without ever sorting a whole key in one task.

    Rows of a key are dealt over ``buckets`` by a hash of ``order``; the counts per (key, bucket), of which there
    are at most ``buckets`` a key, give each bucket its first rank, and only single buckets are sorted. Ranks are
    therefore in hash order, the same on every run when ``order`` tells rows apart; rows that ``order`` can't
    tell apart may swap ranks. Null keys form a key of their own. With no keys, one rank runs over all rows.
    """
    n = buckets or max(64, shuffle_width(df.sparkSession))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(within))
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        ranked.join(firsts, same)
        .withColumn(name, (F.col("_first") + F.col("_r") - 1).cast("long"))
        .drop("_b", "_r", "_first", "_kb", *[f"_k{i}" for i in range(len(keys))])
    )


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows with one of ``ids`` (distinct), which are broadcast if they are few. Null ids stay."""
    return docs.join(few(pinned(ids, "ids")), id_col, "left_anti")
