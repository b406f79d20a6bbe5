"""Monitoring, scheduling, leases, back-off and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, grid, monitor, schedule
from ..operators.predicates import refreshable
from ..sources import tables
from ..sources.tables import SQL
from ..streaming import clicks
from .binding import query

AS_OF = "TIMESTAMP '1998-03-05 07:30:00'"
LOG_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"
ELIGIBLE = SQL + """, eligible AS (SELECT i.* FROM store_items i JOIN stores s ON s.id = i.store_id
    WHERE s.active AND is_boardgame AND is_boardgame_confirmed AND item_id IS NOT NULL AND source_url <> '' AND listing_status = 'LISTED')"""


def eligible(spark, sf):
    stores = tables.stores(spark, sf).where("active").select(F.col("id").alias("store_id"))
    return tables.store_items(spark, sf).where(refreshable()).join(F.broadcast(stores) if stores.count() <= 1_000_000 else stores, "store_id", "left_semi")


def at(text):
    return F.expr(text).cast("timestamp")


@query(ELIGIBLE + f""", l AS (SELECT count(*) AS eligible_items, count(*) FILTER (next_update_at <= {AS_OF}) AS due_items,
    count(*) FILTER (last_updated >= {AS_OF} - INTERVAL 24 HOUR) AS fresh_items, count(*) FILTER (last_updated < {AS_OF} - INTERVAL 24 HOUR) AS stale_items,
    count(DISTINCT store_id) AS stores, coalesce(max(epoch_us({AS_OF}) - epoch_us(next_update_at)) FILTER (next_update_at <= {AS_OF}) / 3600000000.0, 0) AS oldest_due_hours FROM eligible
), a AS (SELECT count(*) AS attempts_24h, count(*) FILTER (status IN ('SUCCEEDED', 'DEACTIVATED')) AS successes_24h, count(*) FILTER (status IN ('FAILED', 'LEASE_LOST')) AS failures_24h
    FROM attempts WHERE started_at >= {AS_OF} - INTERVAL 24 HOUR)
SELECT *, 17280.0::DOUBLE AS daily_capacity, 14400::BIGINT AS window_capacity, round(100.0 * eligible_items / 14400, 1)::DOUBLE AS utilization_percent,
    CASE WHEN eligible_items > 0 THEN round(100.0 * fresh_items / eligible_items, 1) ELSE 100 END::DOUBLE AS fresh_percent,
    CASE WHEN successes_24h + failures_24h > 0 THEN round(100.0 * successes_24h / (successes_24h + failures_24h), 1) ELSE 100 END::DOUBLE AS success_percent FROM l, a""")
def filtered_counts(spark, sf):
    found = monitor.summary(eligible(spark, sf), tables.attempts(spark, sf), at(AS_OF))
    return found.drop("unscheduled_items", "scheduled_later_items")


@query(ELIGIBLE + f""", h AS (SELECT least(greatest(0, floor((epoch_us({AS_OF}) - epoch_us(last_updated)) / 3600000000.0)), 480)::INT AS staleness_hour, count(*) AS n FROM eligible GROUP BY ALL)
SELECT g.hour::INT AS staleness_hour, coalesce(n, 0) AS item_count, g.hour = 480 AS overflow FROM generate_series(0, 480) g(hour) LEFT JOIN h ON h.staleness_hour = g.hour""")
def staleness_histogram(spark, sf):
    return monitor.staleness_histogram(eligible(spark, sf), at(AS_OF), 480)


@query(SQL + f""" SELECT s.id AS store_id, s.canonical_name AS store_name, count(a.id) AS attempts,
    count(a.id) FILTER (a.status IN ('SUCCEEDED', 'DEACTIVATED')) AS successes, count(a.id) FILTER (a.status IN ('FAILED', 'LEASE_LOST')) AS failures,
    max(a.started_at) AS last_attempt_at, max_by(a.error, (a.started_at, a.id)) FILTER (a.status IN ('FAILED', 'LEASE_LOST')) AS last_error,
    CASE WHEN count(a.id) FILTER (a.status <> 'RUNNING') > 0 THEN round(100.0 * count(a.id) FILTER (a.status IN ('SUCCEEDED', 'DEACTIVATED')) / count(a.id) FILTER (a.status <> 'RUNNING'), 1) ELSE 0 END::DOUBLE AS success_rate_percent
FROM stores s LEFT JOIN attempts a ON a.store_id = s.id AND a.started_at >= {LOG_AS_OF} - INTERVAL 15 DAY GROUP BY ALL""")
def store_success_stats(spark, sf):
    return monitor.store_statistics(tables.stores(spark, sf), tables.attempts(spark, sf), at(LOG_AS_OF) - F.expr("INTERVAL 15 DAYS"))


@query(SQL + """ SELECT store_id, max_by(error, (started_at, id)) AS last_error, max(started_at) AS last_failure_at FROM attempts WHERE status = 'FAILED' GROUP BY store_id""")
def last_error_per_store(spark, sf):
    failed = tables.attempts(spark, sf).where("status = 'FAILED'")
    return failed.groupBy("store_id").agg(F.max_by("error", F.struct("started_at", "id")).alias("last_error"), F.max("started_at").alias("last_failure_at"))


@query(SQL + " SELECT id, store_id, status, payload FROM attempts WHERE id > 400 ORDER BY id LIMIT 1000")
def keyset_log_page(spark, sf):
    return grid.keyset_page(tables.attempts(spark, sf), 400, 1000)[0].select("id", "store_id", "status", "payload")


@query(SQL + """, p AS (SELECT id FROM attempts WHERE id > 400 ORDER BY id LIMIT 1001)
SELECT (SELECT count(*) > 1000 FROM p) AS has_more, (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 1000)) AS next_cursor""")
def keyset_cursor(spark, sf):
    return grid.keyset_page(tables.attempts(spark, sf), 400, 1000)[1]


@query(ELIGIBLE + """ SELECT id, store_id, make_timestamp(epoch_us(TIMESTAMP '2024-05-01 15:00:00') + CAST(round(72000000000.0 * ((row_number() OVER w - 1) + (store_id % 8) / 8.0)
    / count(*) OVER (PARTITION BY store_id)) AS BIGINT)) AS next_update_at FROM eligible WINDOW w AS (PARTITION BY store_id ORDER BY id)""")
def schedule_distribution(spark, sf):
    start, end = at("TIMESTAMP '2024-05-01 15:00:00'"), at("TIMESTAMP '2024-05-02 11:00:00'")
    return schedule.distribute(eligible(spark, sf), start, end, (F.col("store_id") % 8) / 8.0)


@query(ELIGIBLE + f""", due AS (SELECT id, store_id, next_update_at FROM eligible WHERE next_update_at <= {AS_OF} AND store_id % 4 <> 0 ORDER BY next_update_at, id LIMIT 256)
SELECT id, store_id, 'token' AS lease_token, {AS_OF} + INTERVAL 300 SECOND AS lease_until FROM due ORDER BY (id * 7919) % 10007, id LIMIT 1""")
def lease_claim(spark, sf):
    listings = eligible(spark, sf).withColumns({"lease_until": F.lit(None).cast("timestamp"), "platform": (F.col("store_id") % 4).cast("string")})
    cooling = spark.createDataFrame([("0", "1999-01-01"), ("1", "1990-01-01")], "platform string, b string").select("platform", F.col("b").cast("timestamp").alias("blocked_until"))
    found = schedule.claim(listings, at(AS_OF), (F.col("id") * 7919) % 10007, "token", cooling=cooling)
    return found.select("id", "store_id", "lease_token", "lease_until")


@query(SQL + f""" SELECT id, CASE least(greatest(consecutive_failures, 1), 4) WHEN 1 THEN 15 WHEN 2 THEN 60 WHEN 3 THEN 360 ELSE 1440 END AS minutes,
    least(greatest(60 * CASE least(greatest(consecutive_failures, 1), 4) WHEN 1 THEN 15 WHEN 2 THEN 60 WHEN 3 THEN 360 ELSE 1440 END, (id * 37) % 100000), 86400) AS cooldown_seconds
FROM store_items WHERE listing_status = 'LISTED'""")
def backoff_ladder(spark, sf):
    listed = tables.store_items(spark, sf).where("listing_status = 'LISTED'")
    start = F.lit("2024-01-01").cast("timestamp")
    until = schedule.cooled_until(start, F.col("consecutive_failures"), (F.col("id") * 37) % 100000)
    return listed.select("id", schedule.backoff_minutes(F.col("consecutive_failures")).alias("minutes"), (F.unix_seconds(until) - F.unix_seconds(start)).alias("cooldown_seconds"))


@query(SQL + """ SELECT id, strftime(started_at - INTERVAL 6 HOUR, '%Y-%m-%d') AS run_date FROM attempts WHERE hour(started_at - INTERVAL 6 HOUR) >= 3""")
def local_run_date(spark, sf):
    made = tables.attempts(spark, sf).select("id", schedule.run_date(F.col("started_at")).cast("string").alias("run_date"))
    return made.where("run_date is not null")


@query(SQL + f""" SELECT id, CASE WHEN status = 'RUNNING' AND epoch_us({LOG_AS_OF}) - epoch_us(started_at) <= 86400000000 THEN 'healthy' WHEN status = 'FAILED' THEN 'stale' WHEN status = 'DEACTIVATED' THEN 'stopped'
    WHEN epoch_us({LOG_AS_OF}) - epoch_us(started_at) <= 86400000000 THEN 'healthy' ELSE 'stale' END AS health FROM attempts""")
def worker_health(spark, sf):
    state = F.when(F.col("status") == "DEACTIVATED", "stopped").when(F.col("status") == "FAILED", "error").otherwise("running")
    log = tables.attempts(spark, sf)
    return log.select("id", monitor.worker_health(state, F.col("started_at"), F.lit(None).cast("timestamp"), at(LOG_AS_OF), 28_800).alias("health"))


@query("""SELECT date_trunc('hour', ts) AS clicked_hour, user_id, count(*) AS click_count FROM events GROUP BY ALL""")
def hourly_clicks(spark, sf):
    return clicks.hourly(tables.read(spark, sf, "events"))


@query(ELIGIBLE + """, n AS (SELECT *, row_number() OVER (ORDER BY last_updated, id) AS r FROM eligible), h AS (SELECT *, CASE WHEN r <= ceil((SELECT least(count(*), 500) FROM eligible) / 2.0) THEN 1 ELSE 2 END AS pool FROM n WHERE r <= 500)
SELECT id, pool, row_number() OVER (PARTITION BY pool ORDER BY (id * 7919) % 10007, id) AS turn FROM h""")
def update_pools(spark, sf):
    return schedule.update_pools(eligible(spark, sf), 500, (F.col("id") * 7919) % 10007).select("id", "pool", "turn")


@query(SQL + """ SELECT status, count(*) AS n, min(started_at) AS first_at, max(started_at) AS last_at, count(DISTINCT store_id) AS stores FROM attempts GROUP BY status""")
def attempt_counts(spark, sf):
    return tables.attempts(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.countDistinct("store_id").alias("stores")
    )


@query(SQL + """ SELECT store_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY store_id, status ORDER BY started_at DESC, id DESC) AS r FROM attempts) WHERE r = 1""")
def latest_per_key(spark, sf):
    log = tables.attempts(spark, sf)
    return catalog.latest(log, ["store_id", "status"], F.col("started_at").desc_nulls_last(), F.col("id").desc()).select("store_id", "id", "status")
