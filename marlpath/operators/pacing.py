"""When requests may start: intervals and cool-downs of hosts as prefix scans, not as waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds between requests to a host, the most that is added, and the least and most that a throttled host is left alone.
INTERVAL, JITTER, FALLBACK, MOST = 2_000_000, 1_000_000, 30_000_000, 300_000_000


def scanned(df: DataFrame, keys: list[str], piece: str, order: list[Column], value: Column, how: str, name: str) -> DataFrame:
    """Adds ``name``: the sum or maximum of ``value`` over the rows before in ``order`` (null for the first). Only single pieces of a key, whose number rises with the order, are sorted."""
    whole = F.sum if how == "sum" else F.max
    join = (lambda a, b: F.coalesce(a + b, a, b)) if how == "sum" else F.greatest
    held = df.withColumn("_v", value)
    totals = held.groupBy(*keys, piece).agg(whole("_v").alias("_t"))
    firsts = totals.withColumn("_f", whole("_t").over(Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    own = whole("_v").over(Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("_o", own).join(firsts, [*keys, piece]).withColumn(name, join(F.col("_o"), F.col("_f"))).drop("_v", "_o", "_f")


def paced(requests: DataFrame, jitter: Column, piece: Column, interval: int = INTERVAL, fallback: int = FALLBACK, most: int = MOST) -> DataFrame:
    """``requests`` (host, id, wanted_at, throttled, retry_after: microseconds) with starts_at, delay and reason.

    Requests of a host start in the order of wanted_at and id, ``interval`` and their ``jitter`` apart at least; one that was
    throttled keeps its host from being asked for retry_after (``fallback`` if null; ``most`` at most). A start is the larger of
    when it is wanted and the start before plus its gap, that is, the gaps before it and the largest lead of any request over
    the gaps before that: a sum and a maximum over the rows before. reason is "cooldown", "pacing" or "".
    """
    asked = F.when(F.col("retry_after").isNull(), F.lit(fallback)).otherwise(F.greatest("retry_after", F.lit(0)))
    cool = F.when(F.col("throttled"), F.least(F.lit(most), asked))
    order = [F.col("wanted_at"), F.col("id")]
    made = requests.withColumns({"_piece": piece, "_pace": F.lit(interval) + jitter, "_cool": cool})
    made = scanned(made, ["host"], "_piece", order, F.greatest("_pace", "_cool"), "sum", "_gaps").withColumn("_gaps", F.coalesce("_gaps", F.lit(0)))
    made = scanned(made, ["host"], "_piece", order, F.col("wanted_at") - F.col("_gaps"), "max", "_lead")
    made = made.withColumn("starts_at", F.col("_gaps") + F.greatest(F.col("wanted_at") - F.col("_gaps"), "_lead"))
    made = scanned(made, ["host"], "_piece", order, F.col("starts_at") + F.col("_cool"), "max", "_cooling")
    made = scanned(made, ["host"], "_piece", order, F.col("starts_at") + F.col("_pace"), "max", "_paced")
    delay = F.col("starts_at") - F.col("wanted_at")
    cooling = (F.col("_cooling") >= F.coalesce("_paced", F.lit(0))) & (F.col("_cooling") > F.col("wanted_at"))
    reason = F.when(delay == 0, "").when(F.coalesce(cooling, F.lit(False)), "cooldown").otherwise("pacing")
    return made.withColumns({"delay": delay, "reason": reason}).drop("_piece", "_pace", "_cool", "_gaps", "_lead", "_cooling", "_paced")
