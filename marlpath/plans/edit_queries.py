"""Edits, imports, queue recovery and batch reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_title_ascii
from ..operators import imports, merge, monitor, schedule
from ..sources import tables
from ..sources.tables import SQL
from .binding import query


#: The listings with one row an id, as ids may repeat in the table that they are derived from.
ONE = SQL + """, one AS (SELECT id, min(store_id) AS store_id, min(item_id) AS item_id, min(source_url) AS source_url, min(listing_status) AS listing_status, bool_or(is_boardgame) AS is_boardgame,
    bool_or(is_boardgame_confirmed) AS is_boardgame_confirmed, min(last_updated) AS last_updated, max(next_update_at) AS next_update_at FROM store_items GROUP BY id)"""


def listings_of(spark, sf):
    """One row an id, dealt by it beforehand: what a task groups, and joins by id, has a bound in rows, which partitions that are merged by their packed sizes lack."""
    dealt = tables.spread_grouped(tables.store_items(spark, sf), "id", tables.read(spark, sf, "lineitem").count())
    least = [F.min(c).alias(c) for c in ("store_id", "item_id", "source_url", "listing_status", "last_updated")]
    either = [F.bool_or(c).alias(c) for c in ("is_boardgame", "is_boardgame_confirmed")]
    return dealt.groupBy("id").agg(*least, *either, F.max("next_update_at").alias("next_update_at"))


@query(SQL + """ SELECT id, canonical_name FROM stores WHERE id % 2 = 0 UNION ALL SELECT id, canonical_name FROM stores WHERE id % 2 = 1 AND active""")
def insert_if_missing(spark, sf):
    stores = tables.stores(spark, sf)
    return merge.insert_missing(stores.where("id % 2 = 0"), stores.where("active"), ["id"]).select("id", "canonical_name")


@query(SQL + """ SELECT (SELECT max(id) FROM items) + row_number() OVER (ORDER BY id) AS id, canonical_domain FROM stores""")
def numbered_inserts(spark, sf):
    stores = tables.stores(spark, sf).withColumnRenamed("id", "store_id")
    return merge.insert_numbered(tables.items(spark, sf), stores, [F.col("store_id")], F.floor(F.col("store_id") / 16)).select("id", "canonical_domain")


@query(ONE + """ SELECT id, CASE WHEN item_id % 9 = 0 THEN 'DELISTED' ELSE listing_status END AS listing_status, coalesce(item_id % 9 = 0 AND listing_status = 'LISTED', false) AS logged FROM one""")
def delisted_pages(spark, sf):
    listings = listings_of(spark, sf)
    after, log = merge.deactivated(listings, listings.where("item_id % 9 = 0"))
    noted = log.where("""old_value = '"LISTED"' and new_value = '"DELISTED"'""").select(F.col("id").alias("n"))
    return after.join(noted, after["id"] == noted["n"], "left").select("id", "listing_status", F.col("n").isNotNull().alias("logged"))


CANDIDATES = SQL + """, c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'APPROVED' ELSE 'PENDING' END AS status, c_name AS store_name,
    CASE WHEN c_custkey % 2 = 0 AND s.id IS NOT NULL THEN s.canonical_domain ELSE 'new' || c_custkey || '.mx' END AS canonical_domain FROM customer LEFT JOIN stores s ON s.id = c_custkey)"""


@query(CANDIDATES + """, chosen AS (SELECT * FROM c WHERE status = 'PENDING' AND id % 5 <> 0)
SELECT s.canonical_domain, coalesce(k.store_name, s.canonical_name) AS canonical_name, s.id <= (SELECT max(id) FROM stores) AS known FROM stores s LEFT JOIN chosen k USING (canonical_domain)
UNION ALL SELECT canonical_domain, store_name, false FROM chosen WHERE canonical_domain NOT IN (SELECT canonical_domain FROM stores)""")
def approved_stores(spark, sf):
    stores = tables.stores(spark, sf)
    own = stores.select(F.col("id").alias("sid"), F.col("canonical_domain").alias("have"))
    key = F.col("c_custkey")
    named = tables.read(spark, sf, "customer").join(own, key == F.col("sid"), "left").select(
        key.alias("id"), F.when(key % 3 == 0, "APPROVED").otherwise("PENDING").alias("status"), F.col("c_name").alias("store_name"),
        F.when((key % 2 == 0) & F.col("have").isNotNull(), F.col("have")).otherwise(F.concat(F.lit("new"), key, F.lit(".mx"))).alias("canonical_domain"),
    )
    _, after = merge.approve(named, stores, named.where("id % 5 <> 0").select("id"))
    last = stores.agg(F.max("id").alias("last"))
    return after.crossJoin(F.broadcast(last)).select("canonical_domain", "canonical_name", (F.col("id") <= F.col("last")).alias("known"))


@query(SQL + """ SELECT (p_partkey * 17) % (SELECT count(*) FROM part) + 100001 AS linked_bgg_id FROM part
EXCEPT SELECT bgg_id FROM items WHERE bgg_id IS NOT NULL EXCEPT SELECT id + 100000 FROM items WHERE id % 6 = 0""")
def import_frontier(spark, sf):
    part, items = tables.read(spark, sf, "part"), tables.items(spark, sf)
    links = part.select(((F.col("p_partkey") * 17) % part.count() + 100001).alias("linked_bgg_id"))
    at = F.lit("2024-06-30").cast("timestamp")
    cache = items.where("id % 3 = 0").select((F.col("id") + 100000).alias("bgg_id"), F.when(F.col("id") % 6 == 0, at - F.expr("INTERVAL 10 DAY")).otherwise(at - F.expr("INTERVAL 200 DAY")).alias("fetched_at"))
    return imports.frontier(links, items, cache, at)


@query(ONE + """, new AS (SELECT id AS listing_id, (SELECT max(id) FROM items) + row_number() OVER (ORDER BY id) AS item_id FROM one WHERE item_id IS NULL)
SELECT s.id, coalesce(s.item_id, n.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN s.listing_status ELSE 'LISTED' END AS listing_status,
    coalesce(n.item_id IS NOT NULL OR s.is_boardgame_confirmed, false) AS confirmed FROM one s LEFT JOIN new n ON n.listing_id = s.id""")
def items_from_listings(spark, sf):
    listings = listings_of(spark, sf).withColumn("title", F.col("source_url"))
    after = imports.create_items(listings, tables.items(spark, sf), fold_title_ascii)["listings"]
    return after.select("id", "item_id", "listing_status", F.col("is_boardgame_confirmed").alias("confirmed"))


@query(ONE + """ SELECT id AS store_item_id, (id * 3) % 50 AS item_id FROM one WHERE item_id IS NULL OR item_id <> (id * 3) % 50""")
def bundled_links(spark, sf):
    listings = listings_of(spark, sf)
    wanted = listings.select(F.col("id").alias("store_item_id"), ((F.col("id") * 3) % 50).alias("item_id"))
    return imports.add_bundled(wanted.where("store_item_id % 2 = 0"), listings, wanted.union(wanted.where("store_item_id % 3 = 0"))).select("store_item_id", "item_id")


@query(ONE + """ SELECT id, item_id FROM one WHERE store_id % 3 <> 0""")
def deleted_listings(spark, sf):
    listings = listings_of(spark, sf)
    links = listings.select(F.col("id").alias("store_item_id"), "item_id")
    left = imports.delete_listings(listings, links, links, listings.where("store_id % 3 = 0").select("id"))
    return left["listings"].select("id", "item_id").join(left["clicks"].select(F.col("store_item_id").alias("id")), "id", "left_semi")


@query(ONE + """ SELECT id, CASE WHEN status = 'RUNNING' AND NOT EXISTS (SELECT 1 FROM one l WHERE l.id % 97 = 0 AND l.id // 97 = a.id AND l.next_update_at > TIMESTAMP '1996-06-01') THEN 'LEASE_LOST' ELSE status END AS status FROM attempts a""")
def recovered_attempts(spark, sf):
    leased = listings_of(spark, sf).where("id % 97 = 0").select(F.floor(F.col("id") / 97).cast("string").alias("lease_token"), F.col("next_update_at").alias("lease_until")).distinct()
    runs = tables.attempts(spark, sf).withColumn("token", F.col("id").cast("string"))
    live = leased.groupBy("lease_token").agg(F.max("lease_until").alias("lease_until"))
    return schedule.recover(runs, live, F.lit("1996-06-01").cast("timestamp")).select("id", "status")


COUNTED = ONE + """, b AS (SELECT id, CASE WHEN is_boardgame THEN 'boardgame' ELSE 'other' END || CASE WHEN is_boardgame_confirmed THEN '_confirmed' ELSE '_open' END AS was FROM one WHERE id % 4 <> 0),
a AS (SELECT id, CASE WHEN is_boardgame OR id % 5 = 0 THEN 'boardgame' ELSE 'other' END || CASE WHEN is_boardgame_confirmed OR id % 7 = 0 THEN '_confirmed' ELSE '_open' END AS now FROM one),
j AS (SELECT a.now, b.was FROM a FULL JOIN b USING (id))"""


@query(COUNTED + """ SELECT k AS class, count(CASE WHEN now = k THEN 1 END) AS n, count(CASE WHEN now = k AND was IS DISTINCT FROM k THEN 1 END) AS gained,
    count(CASE WHEN was = k AND now IS DISTINCT FROM k THEN 1 END) AS lost FROM j, (SELECT DISTINCT now AS k FROM a) GROUP BY k""")
def classification_tally(spark, sf):
    listings = listings_of(spark, sf)
    after = listings.withColumns({"is_boardgame": F.col("is_boardgame") | (F.col("id") % 5 == 0), "is_boardgame_confirmed": F.col("is_boardgame_confirmed") | (F.col("id") % 7 == 0)})
    return monitor.classification_counters(listings.where("id % 4 <> 0"), after)


@query(ONE + """, r AS (SELECT store_id, count(*) AS found, count(item_id) AS saved, CASE WHEN store_id % 7 = 0 THEN 'timeout' END AS error FROM one GROUP BY store_id)
SELECT count(*) AS stores, sum(found)::BIGINT AS found, sum(saved)::BIGINT AS saved, count(error) AS failures, string_agg(CASE WHEN error IS NOT NULL THEN store_id END, ',' ORDER BY store_id) AS failed_stores FROM r""")
def batch_totals(spark, sf):
    runs = listings_of(spark, sf).groupBy("store_id").agg(F.count(F.lit(1)).alias("found"), F.count("item_id").alias("saved"))
    return monitor.batch_summary(runs.withColumn("error", F.when(F.col("store_id") % 7 == 0, "timeout")))


@query(ONE + """ SELECT id, CASE WHEN is_boardgame_confirmed THEN is_boardgame ELSE id % 2 = 0 END AS is_boardgame, is_boardgame_confirmed OR id % 11 = 0 AS is_boardgame_confirmed FROM one""")
def kept_confirmations(spark, sf):
    known = listings_of(spark, sf)
    fresh = known.withColumns({"is_boardgame": F.col("id") % 2 == 0, "is_boardgame_confirmed": F.col("id") % 11 == 0})
    return merge.kept_confirmation(known, fresh).select("id", "is_boardgame", "is_boardgame_confirmed")


@query(ONE + """, c AS (SELECT item_id, min_by(source_url, id) AS url FROM one WHERE id % 3 = 0 AND item_id IS NOT NULL GROUP BY item_id)
SELECT i.id, CASE WHEN i.id % 4 = 0 THEN 'own' ELSE c.url END AS image_url FROM items i LEFT JOIN c ON c.item_id = i.id""")
def copied_covers(spark, sf):
    items = tables.items(spark, sf).withColumn("image_url", F.when(F.col("id") % 4 == 0, "own").otherwise(""))
    listings = listings_of(spark, sf).withColumn("image_url", F.col("source_url"))
    return merge.copied_covers(items, listings, listings.where("id % 3 = 0").select(F.col("id").alias("listing_id"))).select("id", "image_url")


@query(ONE + """, l AS (SELECT id, item_id, CASE WHEN id % 2 = 0 THEN 'PENDING' ELSE listing_status END AS s FROM one)
SELECT id, CASE WHEN s = 'PENDING' AND id % 3 = 0 THEN 'es ' || id END AS description_es, CASE WHEN s = 'PENDING' AND id % 3 = 0 AND item_id IS NOT NULL THEN 'LISTED' ELSE s END AS listing_status FROM l""")
def translated_listings(spark, sf):
    status = F.when(F.col("id") % 2 == 0, "PENDING").otherwise(F.col("listing_status"))
    listings = listings_of(spark, sf).withColumns({"listing_status": status, "description_es": F.lit(None).cast("string")})
    texts = listings.where("id % 3 = 0").select("id", F.concat(F.lit("es "), "id").alias("description_es"))
    return merge.translated(listings, texts).select("id", "description_es", "listing_status")


@query(ONE + """, h AS (SELECT id, last_updated, row_number() OVER (ORDER BY last_updated, id) AS r FROM one ORDER BY last_updated, id LIMIT 1000),
p AS (SELECT *, CASE WHEN r <= ceil((SELECT count(*) FROM h) / 2.0) THEN 1 ELSE 2 END AS pool FROM h),
t AS (SELECT p.*, s.store_id, row_number() OVER (PARTITION BY pool ORDER BY (p.id * 7919) % 10007, p.id) AS turn FROM p JOIN one s USING (id))
SELECT id, CASE WHEN id % 10 = 1 THEN 3 WHEN store_id % 4 = 0 THEN 2 ELSE 1 END AS phase, pool, turn::INT AS turn FROM t WHERE id % 10 <> 2 AND id % 10 <> 3""")
def phased_updates(spark, sf):
    listings = listings_of(spark, sf).select("id", "last_updated", F.concat(F.lit("h"), "store_id").alias("host"), "store_id")
    outcomes = listings.where("id % 10 in (1, 2, 3)").select("id", F.when(F.col("id") % 10 == 1, "transient").when(F.col("id") % 10 == 2, "succeeded").otherwise("removed").alias("outcome"))
    cooling = listings.where("store_id % 4 = 0").select("host")
    return schedule.phased_pools(listings, outcomes, cooling, 1000, (F.col("id") * 7919) % 10007)


@query("""SELECT p_partkey AS item_id, 'a' || p_size AS source_hash FROM part WHERE p_partkey % 2 = 0 OR p_size % 3 = 0""")
def stale_vectors(spark, sf):
    part = tables.read(spark, sf, "part")
    sources = part.select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("a"), "p_size").alias("source_hash"))
    stored = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 3 == 0, "old").otherwise(F.concat(F.lit("a"), "p_size")).alias("source_hash"))
    return imports.vectors_to_embed(sources, stored)


RELATED = SQL + """, r AS (SELECT p_partkey AS a, CASE p_size % 3 WHEN 0 THEN 'extension' WHEN 1 THEN 'expansion' ELSE 'implementation' END AS t, (p_partkey * 13) % (SELECT count(*) FROM part) + 1 AS b, 'old' AS source FROM part WHERE p_partkey % 5 = 0),
w AS (SELECT CASE WHEN p_size % 2 = 0 THEN o ELSE p_partkey END AS a, t, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE o END AS b FROM (SELECT *, (p_partkey * 13) % (SELECT count(*) FROM part) + 1 AS o,
    CASE p_size % 3 WHEN 0 THEN 'extension' WHEN 1 THEN 'expansion' ELSE 'implementation' END AS t FROM part) WHERE o <> p_partkey AND o IN (SELECT p_partkey FROM part)),
s AS (SELECT DISTINCT a, t, b FROM w), k AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.t = r.t AND s.t <> 'expansion' AND s.a = r.b AND s.b = r.a))"""


def edits_of(spark, sf):
    part = tables.read(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size % 3 == 0, "extension").when(size % 3 == 1, "expansion").otherwise("implementation")
    other = (key * 13) % part.count() + 1
    had = part.where("p_partkey % 5 = 0").select(key.alias("item_a_id"), kind.alias("link_type"), other.alias("item_b_id"), F.lit("old").alias("source"), F.lit(None).cast("string").alias("source_ref"))
    wanted = part.select(key.alias("current_id"), other.alias("other_id"), kind.alias("link_type"), F.when(size % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), F.lit("new").alias("source"), F.lit("x").alias("source_ref"))
    groups = part.select(key.alias("item_id"), F.lit("brand").alias("category_type"), F.col("p_brand").alias("category_id"))
    return merge.relate_items(had, groups, tables.items(spark, sf), wanted)


@query(RELATED + """ SELECT coalesce(s.a, k.a) AS item_a_id, coalesce(s.t, k.t) AS link_type, coalesce(s.b, k.b) AS item_b_id, CASE WHEN s.a IS NULL THEN k.source ELSE 'new' END AS source
FROM k FULL JOIN s ON s.a = k.a AND s.t = k.t AND s.b = k.b""")
def related_items(spark, sf):
    return edits_of(spark, sf)["relationships"].select("item_a_id", "link_type", "item_b_id", "source")


@query(RELATED + """ SELECT p_partkey AS item_id, p_brand AS category_id FROM part UNION SELECT s.a, p_brand FROM s JOIN part ON p_partkey = s.b WHERE s.t = 'implementation'""")
def copied_taxonomy(spark, sf):
    return edits_of(spark, sf)["taxonomy"].select("item_id", "category_id")


@query(ONE + """, u AS (SELECT store_id, source_url, min(id) AS id, min(item_id) AS item_id, min(listing_status) AS listing_status FROM one GROUP BY ALL),
had AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'ai' ELSE '' END AS match_source, id % 9 = 0 AS done FROM u WHERE id % 3 <> 0)
SELECT coalesce(h.id, u.id + 1000000000) AS id, u.source_url, h.item_id, coalesce(h.listing_status, 'PENDING') AS listing_status, 'T' || u.id AS title,
    h.id IS NULL OR (h.item_id IS NULL AND h.match_source = '' AND NOT h.done) AS should_process FROM u LEFT JOIN had h ON h.id = u.id""")
def upserted_listings(spark, sf):
    own = listings_of(spark, sf).groupBy("store_id", "source_url").agg(F.min("id").alias("id"), F.min("item_id").alias("item_id"), F.min("listing_status").alias("listing_status"))
    had = own.where("id % 3 <> 0").withColumns({
        "match_source": F.when(F.col("id") % 4 == 0, "ai").otherwise(""), "processed_at": F.when(F.col("id") % 9 == 0, F.lit("2024-01-01").cast("timestamp")), "title": F.lit("old"),
    })
    fresh = own.select("store_id", "source_url", F.concat(F.lit("T"), "id").alias("title"), F.lit("PENDING").alias("listing_status"), F.lit(None).cast("long").alias("item_id"), F.col("id").alias("k"))
    return merge.upsert_listings(had, fresh, F.col("k") + 1_000_000_000).select("id", "source_url", "item_id", "listing_status", "title", "should_process")
