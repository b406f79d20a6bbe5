"""The refresh queue as pure functions of state: distribution over a window, leases, back-off and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import id_bucket, ordered_rank

#: Minutes to wait after the first, second, third and any further failure.
BACKOFF_MINUTES = (15, 60, 360, 1440)


def distribute(eligible: DataFrame, start: Column, end: Column, phase: Column) -> DataFrame:
    """(id, store_id, next_update_at): a store's listings spread evenly over the window, shifted by the store's phase in [0, 1).

    A store's listings are ranked by id, in pieces of neighbouring ids.
    """
    ranked = ordered_rank(eligible, ["store_id"], id_bucket("id"), [F.col("id")], "_rank", "_all")
    micros = (F.unix_micros(end) - F.unix_micros(start)) * ((F.col("_rank") - 1 + phase) / F.col("_all"))
    return ranked.select("id", "store_id", F.timestamp_micros((F.unix_micros(start) + F.round(micros)).cast("long")).alias("next_update_at"))


def run_date(now: Column, zone: str = "America/Mexico_City", start_hour: int = 3) -> Column:
    """The local calendar date that an automatic run belongs to; null before the day's start."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) >= start_hour, F.to_date(local))


def next_local_time(now: Column, hour: int = 5, zone: str = "America/Mexico_City") -> Column:
    """The next instant at which the zone's clocks show ``hour`` o'clock."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.make_dt_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(F.when(local < today, today).otherwise(today + F.expr("INTERVAL 1 DAY")), zone)


def due(listings: DataFrame, as_of: Column, cooling: DataFrame | None = None, most: int = 256) -> DataFrame:
    """The ``most`` longest due listings that nobody leases and whose platform isn't cooling down: a top-k, no full sort."""
    free = listings.where((F.col("next_update_at") <= as_of) & (F.col("lease_until").isNull() | (F.col("lease_until") <= as_of)))
    if cooling is not None:
        blocked = cooling.where(F.col("blocked_until") > as_of).select("platform").distinct()
        free = free.join(blocked, "platform", "left_anti")
    return free.orderBy(F.col("next_update_at").asc(), F.col("id").asc()).limit(most)


def claim(listings: DataFrame, as_of: Column, order: Column, token: str, lease_seconds: int = 300, cooling: DataFrame | None = None) -> DataFrame:
    """One of the due listings, the first in ``order``, with its new lease."""
    chosen = due(listings, as_of, cooling).orderBy(order, F.col("id")).limit(1)
    return chosen.withColumns({"lease_token": F.lit(token), "lease_until": as_of + F.make_dt_interval(secs=F.lit(lease_seconds))})


def backoff_minutes(failures: Column) -> Column:
    """Minutes to wait after so many failures in a row (1 or more)."""
    return F.element_at(F.array(*[F.lit(m) for m in BACKOFF_MINUTES]), F.greatest(F.lit(1), F.least(failures.cast("int"), F.lit(len(BACKOFF_MINUTES)))))


def retry_at(as_of: Column, failures: Column, unit: Column) -> Column:
    """When to try a listing again: the ladder's minutes, ten percent more or less by ``unit`` in [0, 1)."""
    seconds = backoff_minutes(failures) * 60 * (F.lit(0.9) + F.lit(0.2) * unit)
    return F.timestamp_micros((F.unix_micros(as_of) + F.floor(seconds * 1_000_000)).cast("long"))


def cooled_until(as_of: Column, failures: Column, retry_after_seconds: Column) -> Column:
    """When a platform may be asked again: the ladder or its own Retry-After, whichever is longer, at most a day."""
    seconds = F.least(F.greatest(backoff_minutes(failures) * 60, F.coalesce(retry_after_seconds, F.lit(0))), F.lit(86_400))
    return as_of + F.make_dt_interval(secs=seconds)


def apply_outcomes(listings: DataFrame, outcomes: DataFrame, as_of: Column, interval_hours: int = 24) -> DataFrame:
    """The listings after attempts ended: (id, token, outcome) of "succeeded", "removed" or "failed".

    An outcome counts only while its token still holds the lease; others are lost and change nothing.
    """
    joined = listings.join(outcomes.select("id", F.col("token").alias("_t"), "outcome"), "id", "left")
    mine = F.coalesce(F.col("_t") == F.col("lease_token"), F.lit(False))
    ok, gone, bad = (mine & (F.col("outcome") == o) for o in ("succeeded", "removed", "failed"))
    ended = ok | gone | bad
    fails = F.when(ok, 0).when(bad, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    later = as_of + F.make_dt_interval(hours=F.lit(interval_hours))
    nothing = lambda c: F.when(ended, F.lit(None)).otherwise(F.col(c))
    return joined.withColumns(
        {
            "consecutive_failures": fails,
            "next_update_at": F.when(ok, later).when(gone, F.lit(None)).when(bad, retry_at(as_of, fails, F.lit(0.5))).otherwise(F.col("next_update_at")),
            "listing_status": F.when(gone, "DELISTED").otherwise(F.col("listing_status")),
            "lease_token": nothing("lease_token"),
            "lease_until": nothing("lease_until"),
        }
    ).drop("_t", "outcome")


def recover(attempts: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Attempts that still run though their listing's lease has ended are marked as interrupted."""
    live = listings.where(F.col("lease_until") > as_of).select(F.col("lease_token").alias("_live"))
    joined = attempts.join(live, attempts["token"] == live["_live"], "left")
    lost = (F.col("status") == "RUNNING") & F.col("_live").isNull()
    return joined.withColumn("status", F.when(lost, "LEASE_LOST").otherwise(F.col("status"))).drop("_live")


def phased_pools(listings: DataFrame, outcomes: DataFrame, cooling: DataFrame, n: int, order: Column) -> DataFrame:
    """(id, pool, turn) of a batch's work: the two halves of ``update_pools``, then listings of hosts that cool down, then those that failed for a passing reason.

    ``outcomes`` (id, outcome) are the first tries' "succeeded", "removed" or "transient"; ``cooling`` is (host). A
    host's listings wait in the second pool as long as it cools down; the third runs after all others.
    """
    halves = update_pools(listings, n, order)
    hosts = cooling.select("host").distinct().withColumn("_cool", F.lit(True))
    joined = halves.join(F.broadcast(hosts), "host", "left").join(outcomes.select("id", "outcome"), "id", "left")
    phase = F.when(F.col("outcome") == "transient", 3).when(F.col("_cool") & F.col("outcome").isNull(), 2).when(F.col("outcome").isNull(), 1)
    return joined.withColumn("phase", phase).where("phase is not null").select("id", "phase", "pool", "turn")


def update_pools(listings: DataFrame, n: int, order: Column) -> DataFrame:
    """(pool, turn) for a batch of ``n`` listings: the older half first, each half in ``order`` (a seeded hash)."""
    oldest = Window.partitionBy(F.lit(0)).orderBy("last_updated", "id")  # one batch run's listings, at most n
    halved = listings.orderBy("last_updated", "id").limit(n).withColumn("_r", F.row_number().over(oldest))
    total = Window.partitionBy(F.lit(0))
    pooled = halved.withColumn("pool", F.when(F.col("_r") <= F.ceil(F.max("_r").over(total) / 2), 1).otherwise(2))
    return pooled.withColumn("turn", F.row_number().over(Window.partitionBy("pool").orderBy(order, "id"))).drop("_r")
