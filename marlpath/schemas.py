"""Declared schemas, and conforming a table to one: the DataFrame form of "add the column if it is missing"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


STORES = "id bigint, canonical_name string, canonical_domain string, country string, platform string, active boolean"
ITEMS = (
    "id bigint, canonical_name string, normalized_name string, brand string, kind string, size int, price double, item_type string, "
    "bgg_id bigint, rating decimal(8,2), weight decimal(8,2)"
)
STORE_ITEMS = (
    "id bigint, store_id bigint, item_id bigint, source_url string, title string, listing_status string, is_boardgame boolean, "
    "is_boardgame_confirmed boolean, price decimal(12,2), availability string, next_update_at timestamp, last_updated timestamp, "
    "consecutive_failures int, raw_payload string"
)
ATTEMPTS = "id bigint, store_id bigint, status string, started_at timestamp, error string, payload string"
RELATIONSHIPS = "item_a_id bigint, link_type string, item_b_id bigint, source string"


def conform(df: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``, cast, in its order; missing ones get their default or null."""
    have = set(df.columns)
    fill = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(fill.get(f.name))).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(ddl).fields
        ]
    )


#: The states that the tables' columns may have.
LISTING_STATUSES = ("LISTED", "DELISTED", "PENDING")
ITEM_TYPES = ("base_game", "expansion", "unknown")
CANDIDATE_STATUSES = ("PENDING", "APPROVED", "REJECTED")
LINK_TYPES = ("extension", "implementation")


def violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The rows whose ``column`` holds none of ``allowed``; an enum check that runs as a query."""
    return df.where(~F.col(column).isin(*allowed) | F.col(column).isNull())
