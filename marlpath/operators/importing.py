"""Import of external records with all they link to: a closure over links, then one bundle of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import latest
from .lineage import cut
from .merge import insert_missing, insert_numbered, upsert
from .ranking import id_bucket

#: Types of links, and where each goes.
LOOKUPS = {"boardgamecategory": "category", "boardgamemechanic": "mechanic", "boardgamefamily": "family"}
ROLES = {"boardgamedesigner": "designer", "boardgameartist": "artist"}
PUBLISHER, EXPANSION, IMPLEMENTATION = "boardgamepublisher", "boardgameexpansion", "boardgameimplementation"


def fresh_items(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(external_id) of the items that were synchronised within so many days."""
    stale = as_of - F.make_dt_interval(days=F.lit(days))
    return items.where(F.col("bgg_id").isNotNull() & (F.col("bgg_last_sync_at") >= stale)).select(F.col("bgg_id").alias("external_id")).distinct()


def links_of(things: DataFrame) -> DataFrame:
    """(external_id, pos, type, id, name, inbound): a row for each link."""
    return things.select("external_id", F.explode("links").alias("k")).select("external_id", "k.*")


def closure(roots: DataFrame, things: DataFrame, fresh: DataFrame, rounds: int = 1000) -> DataFrame:
    """(external_id, level) of the records to import: ``roots`` and, over links to parents and implementations, all that they lead to.

    Records that are fresh or weren't fetched are not imported and lead nowhere. A level is a join of the last level with
    the links; what was visited is left out, so cycles end. Raises if ``rounds`` don't suffice.
    """
    edges = links_of(things).where((F.col("type") == IMPLEMENTATION) | ((F.col("type") == EXPANSION) & F.col("inbound"))).select("external_id", "id").distinct()
    open_ = things.select("external_id").join(fresh, "external_id", "left_anti")
    edges = cut(edges.join(open_.withColumnRenamed("external_id", "id"), "id", "left_semi"))
    visited = cut(roots.select("external_id").distinct().join(open_, "external_id", "left_semi").withColumn("level", F.lit(0)))
    now = visited
    for level in range(1, rounds):
        step = now.join(edges, "external_id").select(F.col("id").alias("external_id")).distinct().join(visited, "external_id", "left_anti")
        now = cut(step.withColumn("level", F.lit(level)))
        if now.isEmpty():
            return visited
        visited = cut(visited.union(now))
    raise RuntimeError(f"links did not end in {rounds} rounds")


def numbered(known: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (bgg_id, name) with ids after the largest of ``known``, in the order of bgg_id."""
    return insert_numbered(known, new, [F.col("bgg_id")], id_bucket("bgg_id"))


def lookup_after(known: DataFrame, links: DataFrame) -> DataFrame:
    """A lookup table (id, bgg_id, name) after links (bgg_id, name) were put in: known ids take the name, others are added."""
    changed = upsert(known, known.select("id", "bgg_id").join(links, "bgg_id"), ["id"], ["name"])
    new = links.join(known.select("bgg_id").distinct(), "bgg_id", "left_anti")
    return changed.unionByName(numbered(known, new).select("id", "bgg_id", "name"))


def publishers_after(known: DataFrame, links: DataFrame, fold) -> tuple[DataFrame, DataFrame]:
    """Publishers (id, name, normalized_name, bgg_id) after links (bgg_id, name, turn), and (bgg_id, id): which publisher each link is.

    By its id first, then by its name, else it is new; a publisher found by name takes the id of the first such link if it
    has none, and new ones of one name are one publisher with the first link's id.
    """
    by_id = links.join(known.where("bgg_id is not null").groupBy("bgg_id").agg(F.min("id").alias("id")), "bgg_id")
    rest = links.join(by_id.select("bgg_id"), "bgg_id", "left_anti")
    by_name = rest.join(known.groupBy("name").agg(F.min("id").alias("id")), "name")
    lone = rest.join(by_name.select("bgg_id"), "bgg_id", "left_anti")
    first = lone.groupBy("name").agg(F.min_by("bgg_id", "turn").alias("bgg_id"))
    added = numbered(known, first).select("id", "name", fold(F.col("name")).alias("normalized_name"), "bgg_id")
    renamed = by_id.select("id", F.col("name").alias("_name"), F.lit(None).cast("long").alias("_bgg"))
    adopted = by_name.groupBy("id").agg(F.min_by("bgg_id", "turn").alias("_bgg")).select("id", F.lit(None).cast("string").alias("_name"), "_bgg")
    edits = renamed.unionByName(adopted).groupBy("id").agg(F.max("_name").alias("_name"), F.max("_bgg").alias("_bgg"), F.lit(True).alias("_hit"))
    joined = known.join(edits, "id", "left").withColumn("name", F.coalesce("_name", "name"))
    joined = joined.withColumns({"normalized_name": F.when(F.col("_hit"), fold(F.col("name"))).otherwise(F.col("normalized_name")), "bgg_id": F.coalesce("bgg_id", "_bgg")})
    of = by_id.select("bgg_id", "id").unionByName(by_name.select("bgg_id", "id")).unionByName(lone.select("bgg_id", "name").join(added.select("name", "id"), "name").select("bgg_id", "id"))
    return joined.select("id", "name", "normalized_name", "bgg_id").unionByName(added), of


def import_bundle(tables: dict[str, DataFrame], roots: DataFrame, things: DataFrame, as_of: Column, fold, days: int = 180) -> dict[str, DataFrame]:
    """All tables after ``roots`` (external_id) and what they lead to were imported from ``things``.

    ``tables``: items, aliases, lookups (kind, id, bgg_id, name), item_lookups (kind, item_id, lookup_id), contributors,
    item_contributors, publishers, item_publishers and relationships. Of names that differ for one id, the one of the
    record first reached counts, by level and then external id; of an edge and its inverse likewise. An item's parent is
    that of its last link to one.
    """
    things = cut(things)
    taken = cut(closure(roots, things, fresh_items(tables["items"], as_of, days)))
    seen = cut(things.join(taken, "external_id"))
    items, fields = tables["items"], ["canonical_name", "normalized_name", "item_type", "bgg_last_sync_at", "year_published", "rating", "weight", "min_players", "max_players", "min_minutes", "max_minutes", "min_age"]
    fresh = seen.select(
        F.col("external_id").alias("bgg_id"), F.col("name").alias("canonical_name"), fold(F.col("name")).alias("normalized_name"),
        F.when(F.col("kind") == EXPANSION, "expansion").otherwise("base_game").alias("item_type"), as_of.alias("bgg_last_sync_at"), F.col("year").alias("year_published"),
        F.col("rating").cast("decimal(8,2)").alias("rating"), F.col("weight").cast("decimal(8,2)").alias("weight"), "min_players", "max_players", "min_minutes", "max_minutes", "min_age",
    )
    known = items.where("bgg_id is not null").groupBy("bgg_id").agg(F.min("id").alias("id"))
    new = insert_numbered(items, fresh.join(known, "bgg_id", "left_anti"), [F.col("bgg_id")], id_bucket("bgg_id"))
    changed = upsert(items, fresh.join(known, "bgg_id").select("id", *fields), ["id"], fields)
    after = cut(changed.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns])))
    ids = cut(after.where("bgg_id is not null").groupBy(F.col("bgg_id").alias("external_id")).agg(F.min("id").alias("item_id")))

    named = seen.join(ids, "external_id").select("item_id", F.posexplode("alternate_names").alias("pos", "alias")).withColumn("normalized_alias", fold(F.col("alias")))
    alias = latest(named.where("normalized_alias <> ''"), ["item_id", "normalized_alias"], F.col("pos").asc()).select("item_id", "alias", "normalized_alias")
    aliases = upsert(tables["aliases"], alias, ["item_id", "normalized_alias"], ["alias"])
    aliases = insert_missing(aliases, alias, ["item_id", "normalized_alias"])

    turn = F.struct("level", "external_id", "pos")
    links = cut(seen.select("external_id", "level", F.explode("links").alias("k")).select("external_id", "level", "k.*").withColumn("turn", turn).join(ids, "external_id"))
    one_name = lambda of, *keys: of.groupBy(*keys, F.col("id").alias("bgg_id")).agg(F.min_by("name", "turn").alias("name"), F.min("turn").alias("turn"))

    lookups, pairs = None, None
    for kind in LOOKUPS.values():
        own = links.where(F.col("type").isin([t for t, k in LOOKUPS.items() if k == kind]))
        table = lookup_after(tables["lookups"].where(F.col("kind") == kind).drop("kind"), one_name(own).drop("turn"))
        pair = own.select("item_id", F.col("id").alias("bgg_id")).distinct().join(table.select("bgg_id", F.col("id").alias("lookup_id")), "bgg_id").select(F.lit(kind).alias("kind"), "item_id", "lookup_id")
        table = table.select(F.lit(kind).alias("kind"), "id", "bgg_id", "name")
        lookups, pairs = (table, pair) if lookups is None else (lookups.unionByName(table), pairs.unionByName(pair))
    people = links.where(F.col("type").isin(*ROLES))
    contributors = cut(lookup_after(tables["contributors"], one_name(people).drop("turn")))
    role = F.when(F.col("type") == "boardgamedesigner", "designer").otherwise("artist")
    roles = people.select("item_id", F.col("id").alias("bgg_id"), role.alias("role")).distinct().join(contributors.select("bgg_id", F.col("id").alias("contributor_id")), "bgg_id").select("item_id", "contributor_id", "role")
    houses = links.where(F.col("type") == PUBLISHER)
    publishers, house_of = publishers_after(tables["publishers"], cut(one_name(houses)), fold)
    house = houses.select("item_id", F.col("id").alias("bgg_id")).join(house_of.withColumnRenamed("id", "publisher_id"), "bgg_id").select("item_id", "publisher_id").distinct()

    to = links.where((F.col("type") == IMPLEMENTATION) | ((F.col("type") == EXPANSION) & F.col("inbound")))
    to = to.join(ids.select(F.col("external_id").alias("id"), F.col("item_id").alias("linked_id")), "id")
    reach = things.select(F.col("external_id").alias("id")).union(fresh_items(items, as_of, days).withColumnRenamed("external_id", "id")).distinct()
    to = to.join(reach, "id", "left_semi")
    edges = to.select(
        F.when(F.col("inbound"), F.col("item_id")).otherwise(F.col("linked_id")).alias("item_a_id"), F.when(F.col("type") == EXPANSION, "extension").otherwise("implementation").alias("link_type"),
        F.when(F.col("inbound"), F.col("linked_id")).otherwise(F.col("item_id")).alias("item_b_id"), F.col("id").cast("string").alias("source_ref"), "turn",
    )
    edges = edges.groupBy("item_a_id", "link_type", "item_b_id").agg(F.min_by("source_ref", "turn").alias("source_ref"), F.min("turn").alias("turn"))
    two = latest(edges.withColumns({"lo": F.least("item_a_id", "item_b_id"), "hi": F.greatest("item_a_id", "item_b_id")}), ["lo", "link_type", "hi"], F.col("turn").asc())
    two = cut(two.select("item_a_id", "link_type", "item_b_id", F.lit("BGG").alias("source"), "source_ref"))
    inverse = two.select(F.col("item_b_id").alias("item_a_id"), "link_type", F.col("item_a_id").alias("item_b_id"))
    kept = tables["relationships"].join(inverse.unionByName(two.select(*inverse.columns)), ["item_a_id", "link_type", "item_b_id"], "left_anti")
    parents = to.where(F.col("type") == EXPANSION).groupBy(F.col("item_id").alias("id")).agg(F.max_by("linked_id", "pos").alias("parent_item_id"))
    return {
        "items": upsert(after, parents, ["id"], ["parent_item_id"]), "aliases": aliases,
        "lookups": lookups, "item_lookups": insert_missing(tables["item_lookups"], pairs, ["kind", "item_id", "lookup_id"]),
        "contributors": contributors, "item_contributors": insert_missing(tables["item_contributors"], roles, ["item_id", "contributor_id", "role"]),
        "publishers": publishers, "item_publishers": insert_missing(tables["item_publishers"], house, ["item_id", "publisher_id"]),
        "relationships": kept.select("item_a_id", "link_type", "item_b_id", "source", "source_ref").unionByName(two), "imported": taken,
    }


def items_of_listings(tables: dict[str, DataFrame], wanted: DataFrame, as_of: Column, fold) -> dict[str, DataFrame]:
    """All tables after an item was made of each wanted listing (id, implements_id, extends_id: items, or null).

    ``tables``: listings, items, publishers (id, name, normalized_name, bgg_id), item_publishers, relationships and links
    (item_id, category_type, category_id). Listings without a store, a title or an address give none. The listing's publisher
    is found by its trimmed name or added; an item takes the taxonomy of the items that it implements and extends, and an edge to
    either; its listing is matched to it by hand. Of several wishes for one listing the least counts.
    """
    listings = tables["listings"]
    own = wanted.groupBy("id").agg(F.min(F.struct("implements_id", "extends_id")).alias("w")).select("id", "w.*")
    told = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    chosen = listings.where(F.col("store_id").isNotNull() & told("title") & told("source_url")).join(own, "id")
    expansion = F.when(F.col("item_type") == "expansion", "expansion").otherwise("base_game")
    made = chosen.select(
        F.col("id").alias("listing_id"), F.col("title").alias("canonical_name"), fold(F.col("title")).alias("normalized_name"), expansion.alias("item_type"),
        F.col("extends_id").alias("parent_item_id"), F.trim("publisher").alias("house"), "implements_id", "extends_id", *[c for c in ("min_players", "max_players", "min_minutes", "max_minutes", "min_age") if c in listings.columns],
    )
    new = cut(insert_numbered(tables["items"], made, [F.col("listing_id")], id_bucket("listing_id")))
    items = tables["items"]
    added = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns])

    named = new.where(told("house")).groupBy(F.col("house").alias("name")).agg(F.min("listing_id").alias("first")).withColumn("normalized_name", fold(F.col("name")))
    known = tables["publishers"]
    missing = named.join(known.select("name").distinct(), "name", "left_anti")
    fresh = insert_numbered(known, missing, [F.col("first")], id_bucket("first")).select("id", "name", "normalized_name", F.lit(None).cast("long").alias("bgg_id"))
    touched = known.join(named.select("name", F.col("normalized_name").alias("_folded")), "name", "left").withColumn("normalized_name", F.coalesce("_folded", "normalized_name"))
    publishers = cut(touched.select("id", "name", "normalized_name", "bgg_id").unionByName(fresh))
    of_name = publishers.groupBy("name").agg(F.min("id").alias("publisher_id"))
    house = new.where(told("house")).join(of_name, F.col("house") == F.col("name")).select(F.col("id").alias("item_id"), "publisher_id")

    edge = lambda column, kind: new.where(F.col(column).isNotNull()).select(F.col("id").alias("item_a_id"), F.lit(kind).alias("link_type"), F.col(column).alias("item_b_id"), F.lit("admin").alias("source"), F.col("listing_id").cast("string").alias("source_ref"))
    edges = edge("implements_id", "implementation").unionByName(edge("extends_id", "extension"))
    relations = upsert(tables["relationships"], edges, ["item_a_id", "link_type", "item_b_id"], ["source", "source_ref"])
    above = new.select(F.col("id").alias("_new"), F.explode(F.array_distinct(F.array("implements_id", "extends_id"))).alias("item_id")).where("item_id is not null")
    taken = above.join(tables["links"], "item_id").select(F.col("_new").alias("item_id"), "category_type", "category_id")

    hit = new.select(F.col("listing_id").alias("id"), F.col("id").alias("_item"))
    joined = listings.join(hit, "id", "left")
    matched = {"item_id": F.col("_item"), "is_boardgame": F.lit(True), "is_boardgame_confirmed": F.lit(True), "match_source": F.lit("MANUAL"), "matched_name": F.col("title"), "match_score": F.lit(1.0), "processing_error": F.lit(""), "last_updated": as_of}
    after = joined.select(*[F.when(F.col("_item").isNotNull(), matched[c].cast(listings.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in matched else F.col(c) for c in listings.columns])
    return {
        "items": items.unionByName(added), "publishers": publishers, "item_publishers": insert_missing(tables["item_publishers"], house, ["item_id", "publisher_id"]),
        "relationships": relations, "links": insert_missing(tables["links"], taken, ["item_id", "category_type", "category_id"]), "listings": after,
    }
