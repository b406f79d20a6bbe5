"""Upserts, change capture and plans of change: tables in, new tables out, all computed from the state before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_rank


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys; it is still a hash join."""
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return on


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in: new keys are added, known ones take the columns in ``update``.

    ``update`` names columns to overwrite, or maps them to expressions over the old (``t.``) and the new row (``s.``).
    ``source`` has one row a key. Columns that ``source`` lacks keep their value, and are null in new rows.
    """
    t, s = target.alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = t.withColumn("_old", F.lit(True)).alias("t").join(s, on, "full_outer")
    rules = update if isinstance(update, Mapping) else {c: F.col(f"s.{c}") for c in update}
    out = []
    for c in target.columns:
        fresh = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        both = rules[c] if c in rules else F.col(f"t.{c}")
        out.append(F.when(F.col("t._old").isNull(), fresh).when(F.col("s._new").isNull(), F.col(f"t.{c}")).otherwise(both).alias(c))
    return joined.select(*out)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` and those rows of ``source`` whose keys it lacks, one for each key."""
    fresh = source.dropDuplicates(list(keys)).join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def insert_numbered(target: DataFrame, source: DataFrame, order: Sequence[Column], bucket: Column, id_col: str = "id") -> DataFrame:
    """The rows of ``source`` with ids that go on from the largest in ``target``, in ``order``, ranked in pieces of one ``bucket`` each (see ordered_rank)."""
    last = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    ranked = ordered_rank(source, [], bucket, order, "_r")
    return ranked.crossJoin(F.broadcast(last)).withColumn(id_col, F.col("_last") + F.col("_r")).drop("_r", "_last")


def price_changed(old: Column, new: Column) -> Column:
    """Whether two price texts differ: as numbers where both are numbers, so "899.0" is "899.00", else as texts."""
    a, b = (F.trim(x).try_cast("decimal(38,10)") for x in (old, new))
    return F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(~old.eqNullSafe(new))


def canonical_json(text: Column) -> Column:
    """A JSON text in one spelling, keys in order, for comparison; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def as_json(df: DataFrame, field: str, alias: str) -> Column:
    """A field as JSON: texts quoted, numbers and booleans bare, structures with their keys in order, null as null."""
    kind, value = df.schema[field].dataType.simpleString(), F.col(f"{alias}.{field}")
    if kind.startswith("decimal") or kind in ("string", "date", "timestamp"):
        value = F.substring(F.to_json(F.array(value.cast("string"))), F.lit(2), F.length(F.to_json(F.array(value.cast("string")))) - 2)
    elif kind.startswith(("struct", "map", "array")):
        value = canonical_json(F.to_json(value))
    else:
        value = value.cast("string")
    return F.coalesce(value, F.lit("null"))


def kept_confirmation(known: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """``fresh`` listings with is_boardgame and is_boardgame_confirmed of ``known`` ones where these were confirmed by hand."""
    own = known.where("is_boardgame_confirmed").select(F.col(key).alias("_k"), F.col("is_boardgame").alias("_is"))
    joined = fresh.join(own, fresh[key] == own["_k"], "left")
    held = F.col("_k").isNotNull()
    values = {"is_boardgame": F.when(held, F.col("_is")).otherwise(F.col("is_boardgame")), "is_boardgame_confirmed": held | F.coalesce("is_boardgame_confirmed", F.lit(False))}
    return joined.withColumns(values).select(*fresh.columns)


def copied_covers(items: DataFrame, listings: DataFrame, chosen: DataFrame) -> DataFrame:
    """``items`` with the cover of a chosen listing (chosen: listing_id) where the item has none; of several the least listing's."""
    own = listings.join(chosen.select(F.col("listing_id").alias("id")), "id", "left_semi").where("item_id is not null and image_url <> ''")
    cover = own.groupBy("item_id").agg(F.min_by("image_url", "id").alias("_cover"))
    joined = items.join(cover, items["id"] == cover["item_id"], "left")
    empty = F.coalesce(F.nullif(F.col("image_url"), F.lit("")), F.col("_cover"))
    return joined.withColumn("image_url", empty).select(*items.columns)


def translated(listings: DataFrame, translations: DataFrame) -> DataFrame:
    """``listings`` after translations (id, description_es) came: a pending one takes its text and is listed if it has a match; others stay."""
    joined = listings.join(translations.select("id", F.col("description_es").alias("_es")), "id", "left")
    take = (F.col("listing_status") == "PENDING") & (F.coalesce(F.col("_es"), F.lit("")) != "")
    values = {
        "description_es": F.when(take, F.col("_es")).otherwise(F.col("description_es")),
        "listing_status": F.when(take & F.col("item_id").isNotNull(), "LISTED").otherwise(F.col("listing_status")),
    }
    return joined.withColumns(values).select(*listings.columns)


def captured_changes(before: DataFrame, after: DataFrame, fields: Sequence[str], prices: Sequence[str] = ("price",), key: str = "id") -> DataFrame:
    """(key, field_name, old_value, new_value) for each tracked field that differs in rows of both tables, values as JSON; one join, then an unpivot in the row."""
    o, n = before.alias("o"), after.alias("n")
    cases = []
    for f in fields:
        a, b = F.col(f"o.{f}").cast("string"), F.col(f"n.{f}").cast("string")
        differs = price_changed(a, b) if f in prices else ~a.eqNullSafe(b)
        cases.append(F.when(differs, F.struct(F.lit(f).alias("field_name"), as_json(before, f, "o").alias("old_value"), as_json(after, f, "n").alias("new_value"))))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), F.explode(F.array(*cases)).alias("c"))
    return joined.where("c is not null").select(key, "c.*")


def deactivated(listings: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(listings after, change rows): listed ones among ``gone`` are delisted, once."""
    own = gone.select(F.col(key).alias("_g")).distinct()
    marked = listings.join(own, listings[key] == own["_g"], "left")
    hit = F.col("_g").isNotNull() & (F.col("listing_status") == "LISTED")
    after = marked.withColumn("listing_status", F.when(hit, "DELISTED").otherwise(F.col("listing_status"))).drop("_g")
    log = marked.where(hit).select(key, F.lit("listing_status").alias("field_name"), F.lit('"LISTED"').alias("old_value"), F.lit('"DELISTED"').alias("new_value"))
    return after, log


def approve(candidates: DataFrame, stores: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, stores) after approving the pending ones among ``ids``: their stores are put in by domain."""
    chosen = candidates.join(ids, "id", "left_semi").where("status = 'PENDING'")
    named = insert_numbered(stores, chosen.select("canonical_domain", F.col("store_name").alias("canonical_name")).join(stores, "canonical_domain", "left_anti"), [F.col("canonical_domain")], F.left("canonical_domain", F.lit(2)))
    renamed = upsert(stores, chosen.select("canonical_domain", F.col("store_name").alias("canonical_name")), ["canonical_domain"], ["canonical_name"]).where("id is not null")
    added = named.select(*[F.col(c) if c in named.columns else F.lit(None).alias(c) for c in stores.columns])
    done = upsert(candidates, chosen.select("id").withColumn("status", F.lit("APPROVED")), ["id"], ["status"])
    return done, renamed.unionByName(added)


def add_relationship(relationships: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relationships with (item_a_id, link_type, item_b_id) put in; the opposite edge of the same type goes."""
    back = wanted.select(F.col("item_b_id").alias("item_a_id"), "link_type", F.col("item_a_id").alias("item_b_id"))
    key = ["item_a_id", "link_type", "item_b_id"]
    return insert_missing(relationships.join(back, key, "left_anti"), wanted, key)


def relate_items(relationships: DataFrame, taxonomy: DataFrame, items: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Relationships and taxonomy after edits (current_id, other_id, link_type, direction, source, source_ref) of known, different items.

    "incoming" edits run from the other item to the current one. An extension or implementation removes its opposite; a known
    edge takes the new source. An implementation's first item takes the categories of its second (taxonomy: item_id,
    category_type, category_id). Of several edits of one edge the one with the greatest source counts.
    """
    known = items.select("id")
    turned = F.col("direction") == "incoming"
    edges = (
        wanted.where("current_id <> other_id")
        .join(known.withColumnRenamed("id", "current_id"), "current_id", "left_semi").join(known.withColumnRenamed("id", "other_id"), "other_id", "left_semi")
        .select(F.when(turned, F.col("other_id")).otherwise(F.col("current_id")).alias("item_a_id"), "link_type", F.when(turned, F.col("current_id")).otherwise(F.col("other_id")).alias("item_b_id"), "source", "source_ref")
    )
    key = ["item_a_id", "link_type", "item_b_id"]
    saved = edges.groupBy(*key).agg(F.max(F.struct("source", "source_ref")).alias("s")).select(*key, "s.*")
    back = saved.where(F.col("link_type").isin("extension", "implementation")).select(F.col("item_b_id").alias("item_a_id"), "link_type", F.col("item_a_id").alias("item_b_id"))
    after = upsert(relationships.join(back, key, "left_anti"), saved, key, ["source", "source_ref"])
    base = taxonomy.withColumnRenamed("item_id", "item_b_id")
    copied = saved.where("link_type = 'implementation'").join(base, "item_b_id").select(F.col("item_a_id").alias("item_id"), "category_type", "category_id")
    return {"relationships": after, "taxonomy": insert_missing(taxonomy, copied, ["item_id", "category_type", "category_id"])}


def upsert_listings(listings: DataFrame, fresh: DataFrame, next_ids: Column) -> DataFrame:
    """``listings`` with fetched ones put in by (store_id, source_url), null-safe, and should_process.

    Known ones keep id, listing_status and item_id; others are new with the id ``next_ids`` (over the fetched row) and always to be processed.
    A known one is to be processed if it has no item, no match_source and was never processed.
    """
    kept = {"id", "listing_status", "item_id", "match_source", "processed_at", "store_id", "source_url"}
    o, n = listings.withColumn("_old", F.lit(True)).alias("o"), fresh.withColumn("id", next_ids).withColumn("_new", F.lit(True)).alias("n")
    both = n.join(o, F.col("n.store_id").eqNullSafe(F.col("o.store_id")) & F.col("n.source_url").eqNullSafe(F.col("o.source_url")), "full")  # one join gives the fetched and the rest
    has, rest = F.col("o._old").isNotNull(), F.col("n._new").isNull()
    value = lambda c: (F.col(f"n.{c}") if c in fresh.columns or c == "id" else F.lit(None))
    own = lambda c: has if c in kept else rest if c in fresh.columns else F.lit(True)
    return both.select(
        *[F.when(own(c), F.col(f"o.{c}")).otherwise(value(c)).alias(c) for c in listings.columns],
        F.when(rest, False).when(has, F.col("o.item_id").isNull() & (F.coalesce(F.col("o.match_source"), F.lit("")) == "") & F.col("o.processed_at").isNull()).otherwise(True).alias("should_process"),
    )


def delete_items(store_items: DataFrame, additional: DataFrame, relationships: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after items went: their listings wait for a match again, their links and relations go; counts beside them."""
    own = ids.select(F.col("item_id")).distinct()
    flagged = store_items.join(own.withColumn("_gone", F.lit(True)), "item_id", "left")
    gone = F.col("_gone").isNotNull()
    listings = flagged.withColumns(
        {"listing_status": F.when(gone, "PENDING").otherwise(F.col("listing_status")), "item_id": F.when(~gone, F.col("item_id"))}
    ).drop("_gone")
    ends = relationships.join(own.withColumnRenamed("item_id", "item_a_id"), "item_a_id", "left_anti")
    ends = ends.join(own.withColumnRenamed("item_id", "item_b_id"), "item_b_id", "left_anti")
    counts = flagged.agg(F.count_if(gone).alias("reset_listings")).crossJoin(
        additional.join(own, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted_links"))
    )
    return {"store_items": listings.select(*store_items.columns), "additional": additional.join(own, "item_id", "left_anti"), "relationships": ends.select(*relationships.columns), "counts": counts}


def rating_plan(items: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, bgg_id, outcome, rating): what each item with an external id needs; ``cache`` is (bgg_id, found_id, rating), first row of an id."""
    own = items.where("bgg_id is not null").select("id", "bgg_id", F.col("rating").alias("_was"))
    joined = own.join(cache.withColumn("_hit", F.lit(True)), "bgg_id", "left")
    outcome = (
        F.when(F.col("_hit").isNull(), "missing_cache")
        .when(F.col("found_id").isNull() | (F.col("found_id") != F.col("bgg_id")), "malformed")
        .when(F.col("rating").isNull(), "missing_rating")
        .when(F.col("rating").eqNullSafe(F.col("_was")), "unchanged")
        .otherwise("update")
    )
    return joined.select("id", "bgg_id", outcome.alias("outcome"), F.when(outcome == "update", F.col("rating")).alias("rating"))


def repair_plan(links: DataFrame, items: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """What the cached links say the relationships should be: expected, missing, stale, preserved, missing_targets, parent_updates.

    ``links`` is (pos, bgg_id, linked_bgg_id, link_type, inbound) in cache order; ``items`` is (id, bgg_id, parent_item_id).
    The last link of an edge gives its source; a child's parent is that of its last link of the higher priority,
    inbound before outbound.
    """
    me = items.select(F.col("id").alias("me"), "bgg_id")
    other = items.select(F.col("id").alias("other"), F.col("bgg_id").alias("linked_bgg_id"))
    known = links.join(me, "bgg_id").join(other, "linked_bgg_id", "left")
    edges = known.where("other is not null").select(
        "pos", "link_type", "inbound", "linked_bgg_id",
        F.when(F.col("inbound"), F.col("me")).otherwise(F.col("other")).alias("item_a_id"),
        F.when(F.col("inbound"), F.col("other")).otherwise(F.col("me")).alias("item_b_id"),
    )
    key = ["item_a_id", "link_type", "item_b_id"]
    expected = edges.groupBy(*key).agg(F.max_by("linked_bgg_id", "pos").cast("string").alias("source_ref"))
    parents = edges.where("link_type = 'extension'").groupBy("item_a_id").agg(
        F.max_by("item_b_id", F.struct(F.when(F.col("inbound"), 2).otherwise(1), "pos")).alias("parent_item_id")
    )
    old = items.select(F.col("id").alias("item_a_id"), F.col("parent_item_id").alias("previous_parent_id"))
    extra = relationships.where(F.col("link_type").isin("extension", "implementation", "expansion")).join(expected, key, "left_anti")
    ours = F.lower("source") == "bgg"
    return {
        "expected": expected,
        "missing": expected.join(relationships.select(*key), key, "left_anti"),
        "stale": extra.where(ours),
        "preserved": extra.where(~ours),
        "missing_targets": known.where("other is null").select("bgg_id", "linked_bgg_id", "link_type"),
        "parent_updates": parents.join(old, "item_a_id").where(~F.col("parent_item_id").eqNullSafe(F.col("previous_parent_id"))),
    }


def merged_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Both bounds if they are positive and in order, else neither."""
    ok = (F.coalesce(low, F.lit(1)) > 0) & (F.coalesce(high, F.lit(1)) > 0) & ~F.coalesce(low > high, F.lit(False))
    return F.when(ok, low), F.when(ok, high)


def fallback(detail: Column, listing: Column) -> Column:
    """The detail's value, or the listing's where the detail has none or an empty one."""
    return F.coalesce(F.nullif(detail, F.lit("")), listing)
