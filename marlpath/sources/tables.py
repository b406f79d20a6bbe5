"""Catalogue relations over the given tables: each is a narrow projection, so that scans read few columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTEMPTS, ITEMS, STORE_ITEMS, STORES, conform

#: The same relations for DuckDB, as the head of an oracle's WITH clause.
SQL = """
WITH stores AS (
    SELECT s_suppkey AS id, s_name AS canonical_name,
        lower(replace(n_name, ' ', '-')) || '-' || s_suppkey || '.example.com' AS canonical_domain, n_name AS country,
        CASE s_suppkey % 4 WHEN 0 THEN 'shopify' WHEN 1 THEN 'woocommerce' WHEN 2 THEN '' ELSE 'custom' END AS platform,
        s_acctbal >= 0 AS active
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
), items AS (
    SELECT p_partkey AS id, p_name AS canonical_name, lower(p_name) AS normalized_name, p_brand AS brand, p_type AS kind,
        p_size AS size, p_retailprice AS price, CASE WHEN p_size % 7 = 0 THEN 'expansion' ELSE 'base_game' END AS item_type,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey + 100000 END AS bgg_id
    FROM part
), store_items AS (
    SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS store_id,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS item_id,
        'https://www.shop' || l_suppkey || '.example.com/products/p-' || l_partkey AS source_url,
        CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'DELISTED' ELSE 'LISTED' END AS listing_status,
        l_returnflag <> 'R' AS is_boardgame, l_linestatus = 'F' AS is_boardgame_confirmed,
        CAST(l_extendedprice AS DECIMAL(12, 2)) AS price,
        CASE WHEN l_tax < 0.02 THEN 'out_of_stock' WHEN l_tax < 0.06 THEN 'available' ELSE 'unknown' END AS availability,
        l_shipdate AS next_update_at, l_shipdate - INTERVAL 1 DAY AS last_updated, CAST(l_quantity AS INT) % 6 AS consecutive_failures
    FROM lineitem
), attempts AS (
    SELECT event_id AS id, user_id AS store_id,
        CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'signup' THEN 'DEACTIVATED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status,
        ts AS started_at, CASE WHEN event_type = 'error' THEN props END AS error, props AS payload
    FROM events
)"""


#: Rows a task of ``spread``: for work that is heavy by row, and for rows that are only grouped or sorted.
SPREAD, GROUPED = 5000, 250_000
#: Tasks that grouped rows are dealt over at most while none gets more than MOST rows: beyond 200, a task that reads the table no longer writes its rows out as they come, but holds and sorts them.
TASKS, MOST = 200, 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, n: int | None = None, rows: int = SPREAD) -> int:
    """How many tasks ``spread`` deals ``df`` over. ``n`` is its count, if known."""
    n = df.count() if n is None else n
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-n // 500))
    return max(1, least, -(-n // rows))


def spread(df: DataFrame, key: str, n: int | None = None, rows: int = SPREAD) -> DataFrame:
    """``df`` dealt by ``key`` over tasks of ``rows`` rows, for work that is heavy by row: a table of narrow rows has few row groups, so few tasks that would do all of it. ``n`` is its count, if known."""
    return df.repartition(tasks(df, n, rows), key)


def spread_grouped(df: DataFrame, key: str, n: int) -> DataFrame:
    """``spread`` for rows that are only grouped, sorted or joined by ``key``: GROUPED rows a task, and up to MOST of them before there are more than TASKS tasks."""
    return spread(df, key, n, max(GROUPED, min(MOST, -(-n // TASKS))))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    joined = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    found = joined.select(
        key.alias("id"),
        F.col("s_name").alias("canonical_name"),
        F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("-"), key, F.lit(".example.com")).alias("canonical_domain"),
        F.col("n_name").alias("country"),
        F.when(key % 4 == 0, "shopify").when(key % 4 == 1, "woocommerce").when(key % 4 == 2, "").otherwise("custom").alias("platform"),
        (F.col("s_acctbal") >= 0).alias("active"),
    )
    return conform(found, STORES)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    found = read(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("canonical_name"),
        F.lower("p_name").alias("normalized_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") % 7 == 0, "expansion").otherwise("base_game").alias("item_type"),
        F.when(key % 3 != 0, key + 100000).alias("bgg_id"),
    )
    return conform(found, ITEMS)


def store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = F.col("l_shipdate").cast("timestamp")
    found = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("store_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("item_id"),
        F.concat(F.lit("https://www.shop"), "l_suppkey", F.lit(".example.com/products/p-"), "l_partkey").alias("source_url"),
        F.when(shipped < F.lit("1996-01-01").cast("timestamp"), "DELISTED").otherwise("LISTED").alias("listing_status"),
        (F.col("l_returnflag") != "R").alias("is_boardgame"),
        (F.col("l_linestatus") == "F").alias("is_boardgame_confirmed"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_tax") < 0.02, "out_of_stock").when(F.col("l_tax") < 0.06, "available").otherwise("unknown").alias("availability"),
        shipped.alias("next_update_at"),
        (shipped - F.expr("INTERVAL 1 DAY")).alias("last_updated"),
        (F.col("l_quantity").cast("int") % 6).alias("consecutive_failures"),
    )
    return conform(found, STORE_ITEMS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("store_id"),
        F.when(kind == "purchase", "SUCCEEDED").when(kind == "signup", "DEACTIVATED").when(kind == "error", "FAILED").otherwise("RUNNING").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(kind == "error", F.col("props")).alias("error"),
        F.col("props").alias("payload"),
    )
    return conform(found, ATTEMPTS)
