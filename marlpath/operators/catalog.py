"""Catalogue views and reports over items, listings and their links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import ordered_rank


#: Matches that a task ranks.
RANKED = 500_000


def active_items(items: DataFrame, store_items: DataFrame, additional: DataFrame, relationships: DataFrame) -> DataFrame:
    """Items with an eligible listing, directly or bundled, with has_approved_listing and is_expansion.

    The two ways of being an expansion are two key sets, so that the flag is one hash join and no nested loop.
    """
    eligible = store_items.where(F.col("is_boardgame") & F.col("is_boardgame_confirmed"))
    direct = eligible.where(F.col("item_id").isNotNull()).select("item_id", "listing_status")
    bundled = additional.select("store_item_id", "item_id").join(eligible.select(F.col("id").alias("store_item_id"), "listing_status"), "store_item_id")
    links = direct.unionByName(bundled.select("item_id", "listing_status"))
    flags = links.groupBy("item_id").agg(F.coalesce(F.bool_or(F.col("listing_status") == "LISTED"), F.lit(False)).alias("has_approved_listing"))
    children = relationships.where("link_type = 'extension'").select(F.col("item_a_id").alias("x_id")).union(
        relationships.where("link_type = 'expansion'").select("item_b_id")
    ).distinct()
    return (
        items.join(flags, items["id"] == flags["item_id"])
        .join(children, items["id"] == children["x_id"], "left")
        .withColumn("is_expansion", F.col("x_id").isNotNull())
        .drop("item_id", "x_id")
    )


def taxonomy(kinds: dict[str, DataFrame]) -> DataFrame:
    """(item_id, category_type, category_id) of all link tables, each given as (item_id, category_id)."""
    parts = [df.select("item_id", F.lit(kind).alias("category_type"), "category_id") for kind, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_options(dimensions: DataFrame, links: DataFrame, qualified: DataFrame, front_page: DataFrame, only_unlinked: bool = False) -> DataFrame:
    """Every category of every type with its front-page id and its number of qualified items, zero if none.

    ``only_unlinked`` counts items that no front-page category holds yet. One join and one group over all types
    instead of one per type: the type is part of the key.
    """
    key = ["category_type", "category_id"]
    if only_unlinked:
        taken = links.join(front_page.select(*key).distinct(), key, "left_semi").select("item_id").distinct()
        qualified = qualified.join(taken, "item_id", "left_anti")
    counted = links.join(qualified.select("item_id").distinct(), "item_id", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("game_count"))
    shown = front_page.groupBy(*key).agg(F.min("id").alias("front_page_category_id"))
    return dimensions.join(shown, key, "left").join(counted, key, "left").withColumn("game_count", F.coalesce("game_count", F.lit(0)))


def category_products(links: DataFrame, qualified: DataFrame, items: DataFrame, category_type: str, category_id, most: int = 500) -> DataFrame:
    """The first ``most`` qualified items of a category by name."""
    ids = links.where((F.col("category_type") == category_type) & (F.col("category_id") == category_id)).select("item_id")
    found = ids.join(qualified.select("item_id").distinct(), "item_id", "left_semi")
    return items.join(found, items["id"] == found["item_id"]).drop("item_id").orderBy("canonical_name", "id").limit(most)


def front_page_preview(front_page: DataFrame, assigned: DataFrame, products: DataFrame, fields: list[str], rank_by: str) -> DataFrame:
    """Each front-page category with its products as one JSON array, best ``rank_by`` first, nulls last, then item_order, name, id.

    The array is sorted in the aggregate's buffer: the sort keys come first in the structs and aren't shown.
    """
    p = products.withColumnRenamed("id", "item_id")
    shown = F.struct(*[F.col("item_id" if f == "id" else f).alias(f) for f in fields])
    keyed = F.struct(F.col(rank_by).isNull().alias("a"), (-F.col(rank_by)).alias("b"), F.col("item_order").alias("c"), F.col("canonical_name").alias("d"), F.col("item_id").alias("e"), shown.alias("shown"))
    joined = front_page.join(assigned, "front_page_category_id", "left").join(p, "item_id", "left")
    rows = F.collect_list(F.when(F.col("canonical_name").isNotNull(), keyed))
    return joined.groupBy(*front_page.columns).agg(F.to_json(F.transform(F.array_sort(rows), lambda r: r["shown"])).alias("products"))


def relations_of(relationships: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ``ids``: its relations in both directions, with the other item's name. Two equi joins, one for each end."""
    outward = relationships.select(F.col("item_a_id").alias("item_id"), "link_type", F.col("item_b_id").alias("other_id"), F.lit("outbound").alias("direction"))
    inward = relationships.select(F.col("item_b_id").alias("item_id"), "link_type", F.col("item_a_id").alias("other_id"), F.lit("inbound").alias("direction"))
    both = outward.unionByName(inward).join(ids, "item_id", "left_semi")
    return both.join(items.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("other_name")), "other_id")


def with_flag(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with a boolean: is there a row of ``keys`` with the same ``on``?"""
    own = keys.select(F.col(on).alias("_k")).where("_k is not null").distinct()
    return df.join(own, df[on] == own["_k"], "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in ``order``; null keys are a key. Only the winning row of each key is kept while sorting."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ordered_list(value: str, by: str) -> Column:
    """The values of a group in the order of ``by``, nulls left out."""
    pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(by).alias("k"), F.col(value).alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def greedy_assignment(matches: DataFrame, categories: DataFrame, order: Column, cycles: int = 32) -> DataFrame:
    """(front_page_category_id, item_id, item_order): the categories take turns, ``cycles`` times over, each its first item in ``order`` that none has taken.

    ``categories`` is (front_page_category_id, position), position from 1. Instead of one turn after the other, all categories walk
    down their own candidates at once and claim items, each with the time of its turn; an item that another claims at an
    earlier time is passed over. Claims are made anew until none changes. The first turn's claim is right at once and, once
    all claims before a turn are right, so is its own: claims that no longer change are those of the turns one by one.
    A category loses no more items to others than there are turns, so many candidates of each matter: its group is bounded by them.
    They are found in parts of some RANKED matches first, and then among the best of the parts, so no task sorts all of a category.
    """
    n = categories.count()
    turns, step = cycles * n, n + 1
    own = cut(matches.distinct().withColumn("_o", order))
    parts = max(1, -(-own.count() // RANKED))
    first = Window.partitionBy("front_page_category_id", "_part").orderBy("_o", "item_id")
    parted = own.withColumn("_part", F.pmod(F.xxhash64("item_id"), F.lit(parts))).repartition(parts, "front_page_category_id", "_part")
    best = parted.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= turns).drop("_part")
    w = Window.partitionBy("front_page_category_id").orderBy("_o", "item_id")
    top = best.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= turns)
    top = cut(top.join(F.broadcast(categories), "front_page_category_id").select("front_page_category_id", "position", "item_id", "turn"))
    kind = "front_page_category_id long, item_id long, time long"

    def walk(rows: pa.Table) -> pa.Table:
        own = rows.sort_by("turn")
        claims, time, position = [], step, own.column("position")[0].as_py()
        for item, other in zip(own.column("item_id").to_pylist(), own.column("other").to_pylist()):
            if other is None or other > time + position:
                claims.append((item, time + position))
                time += step
                if len(claims) == cycles:
                    break
        category = own.column("front_page_category_id")[0].as_py()
        return pa.table({"front_page_category_id": pa.array([category] * len(claims), pa.int64()), "item_id": pa.array([c[0] for c in claims], pa.int64()), "time": pa.array([c[1] for c in claims], pa.int64())})

    claims, was = None, None
    for _ in range(turns + 2):
        offers = top.withColumn("other", F.lit(None).cast("long"))
        if claims is not None:
            first = F.slice(F.array_sort(F.collect_set("time")), 1, 2).alias("first")  # a time names its category
            held = F.broadcast(claims.groupBy("item_id").agg(first))  # at most ``turns`` items
            own = F.col("first")[0] % step == F.col("position")
            offers = top.join(held, "item_id", "left").withColumn("other", F.when(own, F.try_element_at("first", F.lit(2))).otherwise(F.col("first")[0])).drop("first")
        claims = cut(offers.groupBy("front_page_category_id").applyInArrow(walk, kind))
        now = claims.agg(F.count(F.lit(1)), F.sum(F.xxhash64("front_page_category_id", "item_id", "time") % 1_000_003), F.bit_xor(F.xxhash64("item_id", "time"))).first()
        if now == was:
            break
        was = now
    return claims.select("front_page_category_id", "item_id", F.floor(F.col("time") / step).cast("int").alias("item_order"))


def assignment_bundle(assigned: DataFrame, existing: DataFrame, slots: int) -> dict[str, DataFrame]:
    """What a new assignment changes in ``existing`` (front_page_category_id, item_id, item_order): upserts, deletes (item_id) and the counts that are reported."""
    gone = existing.join(assigned, "item_id", "left_anti").select("item_id")
    numbers = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = numbers(assigned, "assigned_count").withColumn("skipped_count", F.lit(slots) - F.col("assigned_count"))
    for df, name in ((existing, "replaced_count"), (gone, "removed_count")):
        counts = counts.join(F.broadcast(numbers(df, name)))
    return {"upserts": assigned, "deletes": gone, "counts": counts}


def balanced_assignment(matches: DataFrame, position: Column, tie: Column, places: int, pieces: int = 64) -> DataFrame:
    """(item_id, front_page_category_id, item_order): each item goes to its matching category with the fewest matching items from its own place on.

    ``matches`` is (item_id, front_page_category_id). The places are the order of ``position`` (0 or more, spread evenly
    below ``places``); the items that remain in a category are its number less the item's rank. A category is ranked in ``pieces``.
    """
    placed = matches.withColumn("position", position)
    piece = F.floor(F.col("position") * pieces / places)
    ranked = ordered_rank(placed, ["front_page_category_id"], piece, [F.col("position"), F.col("item_id")], "_rank", "_all")
    counted = ranked.withColumn("remaining", F.col("_all") - F.col("_rank") + 1)
    choice = Window.partitionBy("item_id").orderBy("remaining", tie, "front_page_category_id")
    chosen = counted.withColumn("_c", F.row_number().over(choice)).where("_c = 1").select("item_id", "front_page_category_id", "position")
    return ordered_rank(chosen, ["front_page_category_id"], piece, [F.col("position"), F.col("item_id")], "item_order").select("item_id", "front_page_category_id", "item_order")
