"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so the corpus's packing problem is its histogram of piece lengths: at
most ``capacity`` counts, however many documents there are. The plan - which lengths share a sequence, and how
often that same mix is used - is made from the histogram on the driver, by best-two-fit over all documents at
once; the executors then give each piece its place by its gapless rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .frames import gapless_rank, pinned, settled

PIECES = "_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece of each document: id, piece (from 0), start, length, ids (little-endian uint32 bytes), ids_crc32.

    A document is its token ids and then ``end_id``. ``keep_ids`` False leaves ``ids`` null, so that only the
    places are shuffled later. A null or empty text is the single ``end_id``. Repeated rows give repeated pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.byte_bpe(tokenizer)
        for batch in batches:
            at, piece, start, length, ids, crc = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                whole = encoder.ids(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(whole) // 4, capacity)):
                    part = whole[4 * s : 4 * (s + n)]
                    at.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part))
                    ids.append(part if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(crc, pa.int64()),
                ],
                ["_id", "piece", "start", "length", "ids", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(settled(run), PIECES.format(kind=kind))
    return out.withColumnRenamed("_id", id_col)


class _Stock:
    """Pieces not packed yet, by length; the longest available length up to a bound is found by path halving."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.down = [i if i and self.left[i] else i - 1 for i in range(capacity + 1)]
        self.down[0] = 0

    def upto(self, bound: int) -> int:
        """The longest length <= bound with pieces left; 0 if none."""
        down = self.down
        while bound > 0 and down[bound] != bound:
            down[bound] = down[down[bound]] if down[bound] > 0 else 0
            bound = down[bound]
        return max(bound, 0)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.down[length] = length - 1


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths in order, how many sequences have just these), from {length: pieces}.

    Each mix is filled greedily with the longest piece that fits; then its smallest piece is taken out if two
    unpacked pieces fill the gap so expanded more tightly. The mix is used as often as the counts allow, which
    uses a length up: there are no more mixes than lengths, and a few for the remainders.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    stock, plan = _Stock(counts, capacity), []
    while longest := stock.upto(capacity):
        mix: dict[int, int] = {}
        gap, fit = capacity, longest
        while fit:
            room = min(gap // fit, stock.left[fit] - mix.get(fit, 0))
            if room:
                mix[fit] = mix.get(fit, 0) + room
                gap -= room * fit
            fit = stock.upto(min(gap, fit - 1))
        if gap and sum(mix.values()) > 1:
            smallest = min(mix)
            wide, best = gap + smallest, (smallest, 0, 0)
            free = lambda n, also=0: stock.left[n] - mix.get(n, 0) + (n == smallest) - (n == also)  # noqa: E731, B023
            a = stock.upto(wide - 1)
            while a and 2 * a >= best[0] and best[0] < wide:
                if free(a) > 0:
                    b = stock.upto(min(a, wide - a))
                    while b and a + b > best[0]:
                        if free(b, a) > 0:
                            best = (a + b, a, b)
                            break
                        b = stock.upto(b - 1)
                a = stock.upto(a - 1)
            if best[0] > smallest:
                mix[smallest] -= 1
                for n in best[1:]:
                    mix[n] = mix.get(n, 0) + 1
        mix = {n: k for n, k in mix.items() if k}
        times = min(stock.left[n] // k for n, k in mix.items())
        for n, k in mix.items():
            stock.take(n, k * times)
        plan.append(([n for n, k in sorted(mix.items(), reverse=True) for _ in range(k)], times))
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (which has ``length``, 1 to ``capacity``; other values raise).

    ``pieces`` is written once to the shared folder, as the histogram and the placing both read it. The plan that
    is broadcast has at most a few rows per mix and length, whatever the corpus's size. Rows that ``order`` can't
    tell apart are all placed, in either order. An empty table gives an empty one.
    """
    kept = pinned(pieces, "pieces")
    spark = kept.sparkSession
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, used, base = [], {n: 0 for n in counts}, 0
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            rows.append((n, used[n], used[n] + k * times, k, base, offset))
            used[n] += k * times
            offset += n * k
        base += times
    places = spark.createDataFrame(rows, "_len long, _lo long, _hi long, _per long, _base long, _off long")
    ranked = gapless_rank(kept, ["length"], [F.col(c) for c in order], "_rank")
    spot = F.col("_rank") - F.col("_lo")
    return (
        ranked.join(F.broadcast(places), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .withColumn("sequence_id", F.col("_base") + F.floor(spot / F.col("_per")).cast("long"))
        .withColumn("offset", F.col("_off") + (spot % F.col("_per")) * F.col("length"))
        .drop("_rank", "_len", "_lo", "_hi", "_per", "_base", "_off")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, ids (the pieces' ids in place order). ``packed`` must hold ids; a sequence has at most ``capacity`` tokens, so a group is bounded."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.expr("aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), X'', (a, x) -> concat(a, x))").alias("ids"),
    )
