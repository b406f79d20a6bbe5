"""Imports and edits of catalogue items: bundles of new tables, each computed from the tables before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import latest
from .merge import insert_missing, insert_numbered, upsert
from .ranking import id_bucket


def import_records(records: DataFrame, items: DataFrame, aliases: DataFrame, fold) -> dict[str, DataFrame]:
    """Items and aliases after external records (external_id, kind, name, alternate_names, rating) were put in.

    Known items (by bgg_id) take name, rating and type; others are added with new ids. An item's aliases are its
    alternate names, each once by its folded form (``fold``: a column function).
    """
    kind = F.when(F.col("kind") == "boardgameexpansion", "expansion").when(F.col("kind") == "boardgame", "base_game").otherwise("unknown")
    seen = latest(records.where("external_id is not null and name is not null"), ["external_id"], F.col("name").asc())
    fresh = seen.select(F.col("external_id").alias("bgg_id"), F.col("name").alias("canonical_name"), kind.alias("item_type"), F.col("rating").cast("decimal(8,2)").alias("rating"), "alternate_names")
    known = fresh.join(items.where("bgg_id is not null").select("id", "bgg_id"), "bgg_id")
    new = insert_numbered(items, fresh.join(items.select("bgg_id").where("bgg_id is not null").distinct(), "bgg_id", "left_anti"), [F.col("bgg_id")], id_bucket("bgg_id"))
    fields = ["canonical_name", "item_type", "rating"]
    changed = upsert(items, known.select("id", *fields), ["id"], fields)
    added = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in items.columns])
    ids = known.select("id", "alternate_names").unionByName(new.select("id", "alternate_names"))
    named = ids.select(F.col("id").alias("item_id"), F.explode("alternate_names").alias("alias")).withColumn("normalized_alias", fold(F.col("alias")))
    found = latest(named.where("normalized_alias <> ''"), ["item_id", "normalized_alias"], F.col("alias").asc())
    return {"items": changed.unionByName(added), "aliases": insert_missing(aliases, found, ["item_id", "normalized_alias"])}


def frontier(links: DataFrame, items: DataFrame, cache: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """External ids that links name and that are neither imported nor cached within ``days``: what to fetch next."""
    stale = as_of - F.make_dt_interval(days=F.lit(days))
    have = items.where("bgg_id is not null").select(F.col("bgg_id").alias("linked_bgg_id")).union(
        cache.where(F.col("fetched_at") > stale).select(F.col("bgg_id").alias("linked_bgg_id"))
    )
    return links.select("linked_bgg_id").distinct().join(have.distinct(), "linked_bgg_id", "left_anti")


def create_items(listings: DataFrame, items: DataFrame, fold) -> dict[str, DataFrame]:
    """Items after one was made of each listing (id, title, …) without a match, and the listings with them: listed, confirmed, matched by hand."""
    made = insert_numbered(items, listings.where("item_id is null").select(F.col("id").alias("listing_id"), F.col("title").alias("canonical_name")), [F.col("listing_id")], id_bucket("listing_id"))
    made = made.withColumn("normalized_name", fold(F.col("canonical_name")))
    added = made.select(*[F.col(c) if c in made.columns else F.lit(None).alias(c) for c in items.columns])
    new = made.select(F.col("id").alias("_item"), "listing_id")
    joined = listings.join(new, listings["id"] == new["listing_id"], "left")
    hit = F.col("_item").isNotNull()
    after = joined.withColumns(
        {
            "item_id": F.coalesce("item_id", "_item"),
            "listing_status": F.when(hit, "LISTED").otherwise(F.col("listing_status")),
            "is_boardgame_confirmed": F.coalesce(hit | F.col("is_boardgame_confirmed"), F.lit(False)),
        }
    )
    return {"items": items.unionByName(added), "listings": after.select(*listings.columns)}


def add_bundled(additional: DataFrame, listings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links of listings to further items (store_item_id, item_id): each once, and never to a listing's own item."""
    own = listings.where("item_id is not null").select(F.col("id").alias("store_item_id"), "item_id")
    merged = insert_missing(additional, wanted, ["store_item_id", "item_id"])
    return merged.join(own, ["store_item_id", "item_id"], "left_anti")


def delete_listings(listings: DataFrame, clicks: DataFrame, additional: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after listings (ids: id) went, with their hourly clicks and bundled items."""
    of = ids.select(F.col("id").alias("store_item_id")).distinct()
    return {
        "listings": listings.join(ids, "id", "left_anti"),
        "clicks": clicks.join(of, "store_item_id", "left_anti"),
        "additional": additional.join(of, "store_item_id", "left_anti"),
    }


def replace_results(queries: DataFrame, results: DataFrame, new_queries: DataFrame, new_results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A query cache after searches: each query's time is set, and its ranked results are the new ones alone."""
    keys = new_queries.select("query_key").distinct()
    return upsert(queries, new_queries, ["query_key"], ["searched_at"]), results.join(keys, "query_key", "left_anti").unionByName(new_results)


def vectors_to_embed(sources: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """Items whose vector is to be made: all with ``full``, else those without one of the same source text."""
    return sources if full else sources.join(stored.select("item_id", "source_hash"), ["item_id", "source_hash"], "left_anti")


def write_vectors(vectors: DataFrame, path: str, size: int) -> None:
    """Stores (item_id, source_hash, vector) as float arrays, one row an item; a vector of another length than ``size`` raises."""
    values = F.col("vector").cast("array<float>")
    right = F.when(F.size("vector") == size, values).otherwise(F.raise_error(F.concat(F.lit("a vector of another length: item "), F.col("item_id").cast("string"))))
    vectors.groupBy("item_id").agg(F.max_by(F.struct("source_hash", "vector"), "source_hash").alias("v")).select("item_id", "v.*").select("item_id", "source_hash", right.alias("vector")).write.mode("overwrite").parquet(path)


def tutorial_queue(items: DataFrame, links: DataFrame, skipped: list[int]) -> DataFrame:
    """Active items that have no tutorial yet and weren't skipped, best rated first."""
    open_items = items.join(links.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    return open_items.where(~F.col("id").isin(skipped)).orderBy(F.col("rating").desc_nulls_last(), F.col("id"))
