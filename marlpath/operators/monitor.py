"""Refresh monitoring: summaries, histograms, per-store statistics and worker health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE, FAILED = ("SUCCEEDED", "DEACTIVATED"), ("FAILED", "LEASE_LOST")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def summary(eligible: DataFrame, attempts: DataFrame, as_of: Column, poll_seconds: int = 5, window_hours: int = 20) -> DataFrame:
    """One row: how many listings are due, fresh or stale, what the last day's attempts gave, and how the plan's capacity is used."""
    day = as_of - F.expr("INTERVAL 24 HOURS")
    listings = eligible.agg(
        F.count(F.lit(1)).alias("eligible_items"),
        F.count_if(F.col("next_update_at").isNull()).alias("unscheduled_items"),
        F.count_if(F.col("next_update_at") <= as_of).alias("due_items"),
        F.count_if(F.col("next_update_at") > as_of).alias("scheduled_later_items"),
        F.count_if(F.col("last_updated") >= day).alias("fresh_items"),
        F.count_if(F.col("last_updated") < day).alias("stale_items"),
        F.coalesce(F.max(F.when(F.col("next_update_at") <= as_of, hours_between(as_of, F.col("next_update_at")))), F.lit(0.0)).alias("oldest_due_hours"),
        F.countDistinct("store_id").alias("stores"),
    )
    recent = attempts.where(F.col("started_at") >= day).agg(
        F.count(F.lit(1)).alias("attempts_24h"),
        F.count_if(F.col("status").isin(*DONE)).alias("successes_24h"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failures_24h"),
    )
    capacity = int(window_hours * 3600 // poll_seconds)
    percent = lambda a, b, none: F.when(b > 0, F.round(F.lit(100.0) * a / b, 1)).otherwise(F.lit(float(none)))
    finished = F.col("successes_24h") + F.col("failures_24h")
    return listings.crossJoin(recent).select(  # one row each
        "*",
        F.lit(86_400.0 / poll_seconds).alias("daily_capacity"),
        F.lit(capacity).cast("long").alias("window_capacity"),
        percent(F.col("eligible_items"), F.lit(capacity), 0).alias("utilization_percent"),
        percent(F.col("fresh_items"), F.col("eligible_items"), 100).alias("fresh_percent"),
        percent(F.col("successes_24h"), finished, 100).alias("success_percent"),
    )


def staleness_histogram(listings: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """(staleness_hour, item_count, overflow): a zero-filled bucket for each hour below ``hours``, and one for all above."""
    age = F.greatest(F.lit(0), F.floor(hours_between(as_of, F.col("last_updated")))).cast("int")
    counted = listings.where("last_updated is not null").groupBy(F.least(age, F.lit(hours)).alias("staleness_hour")).agg(F.count(F.lit(1)).alias("n"))
    frame = listings.sparkSession.range(hours + 1).select(F.col("id").cast("int").alias("staleness_hour"))
    return frame.join(F.broadcast(counted), "staleness_hour", "left").select(  # at most hours + 1 rows
        "staleness_hour", F.coalesce("n", F.lit(0)).alias("item_count"), (F.col("staleness_hour") == hours).alias("overflow")
    )


def store_statistics(stores: DataFrame, attempts: DataFrame, since: Column) -> DataFrame:
    """Each store with its attempts since a time, successes, failures, success rate, and its last error.

    Attempts are aggregated before the join, so a store with very many costs one row; stores without any are kept.
    The last error is that of the latest failure; failures without a time count as latest.
    """
    failed = F.col("status").isin(*FAILED)
    own = attempts.where(F.col("started_at") >= since).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status").isin(*DONE)).alias("successes"),
        F.count_if(failed).alias("failures"),
        F.max("started_at").alias("last_attempt_at"),
        F.max_by("error", F.when(failed, F.struct(F.coalesce("started_at", F.lit("9999-12-31").cast("timestamp")), "id"))).alias("last_error"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = stores.select(F.col("id").alias("store_id"), F.col("canonical_name").alias("store_name")).join(own, "store_id", "left")
    done = F.col("successes") + F.col("failures")
    return joined.select("store_id", "store_name", count("attempts"), count("successes"), count("failures"), "last_attempt_at", "last_error").withColumn(
        "success_rate_percent", F.when(done > 0, F.round(F.lit(100.0) * F.col("successes") / done, 1)).otherwise(0.0)
    )


def classification_counters(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(class, n, gained, lost) of the four classes by is_boardgame and its confirmation, after listings were classified anew.

    The counts that a running tally, one up and one down at each change, ends with: one join, one group.
    """
    def label(game, sure):
        return F.concat(F.when(game, "boardgame").otherwise("other"), F.when(sure, "_confirmed").otherwise("_open"))

    own = before.select(F.col(key).alias("_k"), label(F.col("is_boardgame"), F.col("is_boardgame_confirmed")).alias("was"))
    joined = after.select(F.col(key).alias("_n"), label(F.col("is_boardgame"), F.col("is_boardgame_confirmed")).alias("now")).join(own, F.col("_n") == F.col("_k"), "full")
    moves = joined.select(F.explode(F.array(F.struct(F.col("now").alias("class"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("was").alias("class"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m"), F.col("now").eqNullSafe(F.col("was")).alias("same"))
    rows = moves.where("m.class is not null").select("m.*", "same")
    return rows.groupBy("class").agg(F.sum("up").alias("n"), F.sum(F.when(~F.col("same"), F.col("up")).otherwise(0)).alias("gained"), F.sum(F.when(~F.col("same"), F.col("down")).otherwise(0)).alias("lost"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row for a batch over stores (store_id, found, saved, error): sums, and the failed stores in order."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("store_id"))))
    return runs.agg(
        F.count(F.lit(1)).alias("stores"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
        F.count("error").alias("failures"), F.array_join(failed.cast("array<string>"), ",").alias("failed_stores"),
    )


def worker_health(status: Column, heartbeat: Column, lease_until: Column, as_of: Column, poll_seconds: int) -> Column:
    """stopped, or healthy with a live lease or a heartbeat of the last three polls (30 s at least), else stale."""
    limit = max(30, 3 * poll_seconds)
    live = (status == "running") & (lease_until > as_of)
    recent = F.unix_micros(as_of) - F.unix_micros(heartbeat) <= limit * 1_000_000
    return F.when(status == "stopped", "stopped").when(status == "error", "stale").when(F.coalesce(live, F.lit(False)) | F.coalesce(recent, F.lit(False)), "healthy").otherwise("stale")


def latest_as_json(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in ``order`` as one JSON text."""
    return df.orderBy(*order).limit(1).select(F.to_json(F.struct("*")).alias("row"))
