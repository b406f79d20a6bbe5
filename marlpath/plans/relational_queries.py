"""Upserts, change capture, plans and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, merge
from ..operators.predicates import platform_of
from ..sources import pages, tables
from ..sources.tables import SQL
from .binding import query


def orders(spark, sf):
    return tables.read(spark, sf, "orders")


@query("""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END::DECIMAL(14, 2)::VARCHAR AS price,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS availability, o_totalprice::DECIMAL(14, 2)::VARCHAR AS was_price, o_orderstatus AS was FROM orders)
SELECT id, 'price' AS field_name, '"' || was_price || '"' AS old_value, '"' || price || '"' AS new_value FROM n WHERE was_price <> price
UNION ALL SELECT id, 'availability', '"' || was || '"', coalesce('"' || availability || '"', 'null') FROM n WHERE was IS DISTINCT FROM availability""")
def change_capture(spark, sf):
    amount = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    before = orders(spark, sf).select(F.col("o_orderkey").alias("id"), amount.alias("price"), F.col("o_orderstatus").alias("availability"))
    more = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(14,2)").cast("string")
    after = orders(spark, sf).select(F.col("o_orderkey").alias("id"), more.alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("availability"))
    return merge.captured_changes(before, after, ["price", "availability"])


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, coalesce(a.first_seen, b.first_seen) AS first_seen
FROM (SELECT c_custkey AS k, c_name AS name, 1 AS first_seen FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT c_custkey AS k, upper(c_name) AS name, 2 AS first_seen FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def merge_upsert(spark, sf):
    customer = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    target = customer.where("k % 3 <> 0").withColumn("first_seen", F.lit(1))
    source = customer.where("k % 2 = 0").select("k", F.upper("name").alias("name"), F.lit(2).alias("first_seen"))
    return merge.upsert(target, source, ["k"], ["name"])


@query("""WITH t AS (SELECT o_custkey AS k, max(o_orderdate) AS until, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
s AS (SELECT o_custkey AS k, max(o_orderdate) AS until FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(t.k, s.k) AS k, greatest(t.until, s.until) AS until, CASE WHEN s.k IS NULL THEN n WHEN t.k IS NULL THEN 1 ELSE n + 1 END AS n FROM t FULL JOIN s ON t.k = s.k""")
def merge_counter(spark, sf):
    made = orders(spark, sf).select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("until"), "o_orderstatus")
    target = made.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("until").alias("until"), F.count(F.lit(1)).alias("n"))
    source = made.where("o_orderstatus <> 'F'").groupBy("k").agg(F.max("until").alias("until")).withColumn("n", F.lit(1).cast("long"))
    return merge.upsert(target, source, ["k"], {"until": F.greatest("t.until", "s.until"), "n": F.col("t.n") + 1})


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS k, o_orderpriority AS p FROM orders),
known AS (SELECT DISTINCT k, p FROM o WHERE id % 10 = 0)
SELECT o.id, known.p IS NOT NULL AS known FROM o LEFT JOIN known ON o.k IS NOT DISTINCT FROM known.k AND o.p = known.p""")
def nullsafe_existing(spark, sf):
    made = orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderpriority").alias("p"))
    known = made.where("id % 10 = 0").select(F.col("k").alias("k2"), F.col("p").alias("p2")).distinct()
    joined = made.join(known, F.col("k").eqNullSafe(F.col("k2")) & (F.col("p") == F.col("p2")), "left")
    return joined.select("id", F.col("p2").isNotNull().alias("known"))


@query("""SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def anti_missing_cache(spark, sf):
    cached = tables.read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(cached, "id", "left_anti")


@query("""SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text""")
def dedupe_first_wins(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT o_custkey AS k, o_orderkey AS pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_of_merge(spark, sf):
    found = orders(spark, sf).select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("accepted"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("pos"))
    return match.best_of(found, "k").select("k", "pos")


@query(SQL + """, c AS (SELECT id + 100000 AS bgg_id, CASE WHEN id % 13 = 0 THEN 1 ELSE id + 100000 END AS found_id, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 90) / 10.0 END::DECIMAL(8,2) AS rating FROM items WHERE id % 2 = 0)
SELECT outcome, count(*) AS n, coalesce(sum(rating), 0)::DOUBLE AS total FROM (SELECT CASE WHEN c.bgg_id IS NULL THEN 'missing_cache' WHEN c.found_id <> i.bgg_id THEN 'malformed' WHEN c.rating IS NULL THEN 'missing_rating'
    WHEN c.rating = (i.size % 9)::DECIMAL(8,2) THEN 'unchanged' ELSE 'update' END AS outcome, CASE WHEN c.found_id = i.bgg_id AND c.rating <> (i.size % 9)::DECIMAL(8,2) THEN c.rating END AS rating
    FROM items i LEFT JOIN c ON c.bgg_id = i.bgg_id WHERE i.bgg_id IS NOT NULL) GROUP BY outcome""")
def rating_sync_plan(spark, sf):
    items = tables.items(spark, sf).withColumn("rating", (F.col("size") % 9).cast("decimal(8,2)"))
    cache = items.where("id % 2 = 0").select(
        (F.col("id") + 100000).alias("bgg_id"), F.when(F.col("id") % 13 == 0, 1).otherwise(F.col("id") + 100000).alias("found_id"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 90) / 10.0).cast("decimal(8,2)").alias("rating"),
    )
    plan = merge.rating_plan(items, cache)
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rating"), F.lit(0)).cast("double").alias("total"))


REPAIR = SQL + """, l AS (SELECT p_partkey AS pos, p_partkey + 100000 AS bgg_id, (p_partkey * 17) % (SELECT count(*) FROM part) + 100001 AS linked_bgg_id,
    CASE WHEN p_size % 4 = 0 THEN 'implementation' ELSE 'extension' END AS link_type, p_size % 2 = 0 AS inbound FROM part
), k AS (SELECT l.*, m.id AS me, o.id AS other FROM l JOIN items m ON m.bgg_id = l.bgg_id LEFT JOIN items o ON o.bgg_id = l.linked_bgg_id
), e AS (SELECT *, CASE WHEN inbound THEN me ELSE other END AS a, CASE WHEN inbound THEN other ELSE me END AS b FROM k WHERE other IS NOT NULL
), x AS (SELECT a AS item_a_id, link_type, b AS item_b_id, max_by(linked_bgg_id, pos)::VARCHAR AS source_ref FROM e GROUP BY ALL
), p AS (SELECT a AS item_a_id, max_by(b, (CASE WHEN inbound THEN 2 ELSE 1 END, pos)) AS parent FROM e WHERE link_type = 'extension' GROUP BY a
), r AS (SELECT item_a_id, link_type, item_b_id FROM x WHERE item_a_id % 2 = 0)"""


@query(REPAIR + """ SELECT 'missing' AS step, item_a_id AS a, item_b_id AS b, source_ref AS ref FROM x WHERE item_a_id % 2 <> 0
UNION ALL SELECT 'parent', item_a_id, parent, NULL FROM p WHERE parent IS DISTINCT FROM item_a_id - 1
UNION ALL SELECT 'target', bgg_id, linked_bgg_id, link_type FROM k WHERE other IS NULL""")
def relationship_repair(spark, sf):
    part = tables.read(spark, sf, "part")
    links = part.select(
        F.col("p_partkey").alias("pos"), (F.col("p_partkey") + 100000).alias("bgg_id"), ((F.col("p_partkey") * 17) % part.count() + 100001).alias("linked_bgg_id"),
        F.when(F.col("p_size") % 4 == 0, "implementation").otherwise("extension").alias("link_type"), (F.col("p_size") % 2 == 0).alias("inbound"),
    )
    items = tables.items(spark, sf).where("bgg_id is not null").select("id", "bgg_id", (F.col("id") - 1).alias("parent_item_id"))
    none = spark.createDataFrame([], "item_a_id long, link_type string, item_b_id long, source string")
    first = merge.repair_plan(links, items, none)
    have = first["expected"].where("item_a_id % 2 = 0").select("item_a_id", "link_type", "item_b_id", F.lit("bgg").alias("source"))
    plan = merge.repair_plan(links, items, have)
    step = lambda name, df, a, b, ref: df.select(F.lit(name).alias("step"), F.col(a).alias("a"), F.col(b).alias("b"), ref.cast("string").alias("ref"))
    return (
        step("missing", plan["missing"], "item_a_id", "item_b_id", F.col("source_ref"))
        .unionByName(step("parent", plan["parent_updates"], "item_a_id", "parent_item_id", F.lit(None)))
        .unionByName(step("target", plan["missing_targets"], "bgg_id", "linked_bgg_id", F.col("link_type")))
    )


@query(SQL + """, own AS (SELECT id AS item_id FROM items WHERE id % 50 = 0), g AS (SELECT id, i.item_id, listing_status, own.item_id IS NOT NULL AS gone FROM store_items i LEFT JOIN own ON own.item_id = i.item_id)
SELECT CASE WHEN gone THEN 'PENDING' ELSE listing_status END AS listing_status, count(*) AS n, count(CASE WHEN gone THEN NULL ELSE item_id END) AS matched FROM g GROUP BY 1""")
def delete_items_bundle(spark, sf):
    from .catalog_queries import additional, relationships

    ids = tables.items(spark, sf).where("id % 50 = 0").select(F.col("id").alias("item_id"))
    after = merge.delete_items(tables.store_items(spark, sf), additional(spark, sf), relationships(spark, sf), ids)["store_items"]
    return after.groupBy("listing_status").agg(F.count(F.lit(1)).alias("n"), F.count("item_id").alias("matched"))


@query("""WITH l AS (SELECT o_orderkey AS listing_id, p_name || CASE WHEN o_orderkey % 3 = 0 THEN ' english edition' ELSE '' END AS title FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) + 1),
n AS (SELECT p_partkey AS item_id, p_name AS name FROM part), t AS (SELECT DISTINCT title FROM l),
w AS (SELECT DISTINCT title, unnest(string_split(title, ' ')) AS token FROM t), h AS (SELECT item_id, name, unnest(string_split(name, ' ')) AS token FROM n),
s AS (SELECT title, item_id, name, count(*) AS shared FROM w JOIN h USING (token) GROUP BY ALL),
p AS (SELECT title, item_id, max(shared) AS overlap, bool_or(name = title) AS exact FROM s GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY exact DESC, overlap DESC, item_id) AS rank FROM p) WHERE rank <= 100),
b AS (SELECT title, bool_or(exact) AS exact, string_agg(item_id, ',' ORDER BY rank) AS items, string_agg(overlap, ',' ORDER BY rank) AS shared FROM r GROUP BY title)
SELECT listing_id, exact, items, shared FROM l JOIN b USING (title)""")
def token_overlap_block(spark, sf):
    part = tables.read(spark, sf, "part")
    names = part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    sold = orders(spark, sf).withColumn("item_id", F.col("o_orderkey") % part.count() + 1)
    listings = sold.join(names, "item_id").select(F.col("o_orderkey").alias("listing_id"), F.concat("name", F.when(F.col("o_orderkey") % 3 == 0, " english edition").otherwise("")).alias("title"))
    found = match.candidate_lists(listings, names)
    joined = lambda field: F.array_join(F.transform("found", lambda x: x[field].cast("string")), ",")
    return found.select("listing_id", F.exists("found", lambda x: x["exact"]).alias("exact"), joined("item_id").alias("items"), joined("overlap").alias("shared"))


@query()
def match_scores(spark, sf):
    """The best catalogue item of each order's made-up listing, with score and reasons; tested against the scoring rules. Equal titles are scored once."""
    part = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    sold = orders(spark, sf).withColumn("item_id", F.col("o_orderkey") % part.count() + 1)
    listings = sold.join(part, "item_id").select(F.col("o_orderkey").alias("listing_id"), F.concat("name", F.lit(" english edition")).alias("title"))
    titles = listings.groupBy("title").agg(F.min("listing_id").alias("title_id"))
    known = titles.select("title_id", match.title_variants(F.col("title")).alias("variants"), match.search_words(F.col("title")).alias("words"))
    pairs = match.title_candidates(known, part.select("item_id", "name")).select("title_id", "item_id").join(titles, "title_id").join(part, "item_id")
    none = F.lit(None).cast("string")
    names = F.array(F.struct(F.lit("item name").alias("label"), F.col("name")))
    full = pairs.select("title_id", "item_id", "title", names.alias("names"), F.array("brand").alias("publishers"), none.alias("publisher"), none.alias("store_name"), none.alias("kind"), none.alias("item_kind"))
    best = match.scored(full).groupBy("title_id").agg(F.max_by(F.struct("item_id", "match_score", "match_reasons", "accepted"), F.struct("match_score", -F.col("item_id"))).alias("b"))
    found = best.select("title_id", "b.*").withColumn("match_reasons", F.array_join("match_reasons", "; "))
    return listings.join(titles, "title").select("listing_id", "title_id").join(found, "title_id").drop("title_id")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, sha256(props) AS digest FROM events""")
def json_fields_and_hashes(spark, sf):
    made = tables.read(spark, sf, "events")
    return made.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.sha2("props", 256).alias("digest"))


def packed_events(events, most=50_000):
    """(user_id, data): each user's events as JSON arrays of at most ``most``, so that no user is one unbounded group."""
    rows = F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"t":"'), "event_type", F.lit('"}')))), F.lit("]"))
    run = events.withColumn("run", F.floor(F.monotonically_increasing_id() / most))
    return run.groupBy("user_id", "run").agg(rows.alias("data")).drop("run")


@query("""SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events""")
def json_recordset(spark, sf):
    events = tables.read(spark, sf, "events")
    return pages.json_rows(packed_events(events), "data", "k int, t string").select("user_id", "k", F.col("t").alias("event_type"))


@query(SQL + """ SELECT s.id, CASE WHEN trim(platform) <> '' THEN platform WHEN canonical_domain ILIKE '%a%' THEN 'shopify' ELSE 'custom' END AS platform FROM stores s""")
def platform_fallback(spark, sf):
    hint = F.when(F.col("canonical_domain").ilike("%a%"), '{"via": "Shopify"}').otherwise("{}")
    return tables.stores(spark, sf).select("id", platform_of(F.col("platform"), hint).alias("platform"))


@query("""WITH p AS (SELECT l_suppkey AS store_id, l_linenumber AS page, l_orderkey * 8 + l_linenumber AS key FROM lineitem), s AS (SELECT store_id, count(DISTINCT key) AS n, count(*) AS c FROM p GROUP BY 1)
SELECT store_id, 'keys missing' AS fault FROM s WHERE n <> c + CASE WHEN store_id % 3 = 0 THEN 1 ELSE 0 END""")
def catalogue_integrity(spark, sf):
    line = tables.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    declared = line.groupBy("store_id").agg(F.count(F.lit(1)).alias("declared")).withColumn("declared", F.col("declared") + F.when(F.col("store_id") % 3 == 0, 1).otherwise(0))
    size = line.groupBy("store_id", "page").agg(F.count(F.lit(1)).alias("page_size"))
    return pages.catalogue_faults(line.join(declared, "store_id").join(size, ["store_id", "page"]))


@query("""SELECT c.conv_id, t.text AS first_user_text FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1) t USING (conv_id)""")
def cache_cascade(spark, sf):
    talk = tables.read(spark, sf, "conversations")
    first = talk.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("value")).select(F.col("conv_id").alias("key"), "value")
    never = first.where("key < 0")
    return match.cache_lookup(talk.select(F.col("conv_id").alias("key")).distinct(), never, first).select(F.col("key").alias("conv_id"), F.col("value").alias("first_user_text"))


CASCADE = """WITH w AS (SELECT p_partkey AS query_id, p_name AS query, lower(p_name) AS folded, 'img' || p_size AS context FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 3), lower(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 3)), NULL FROM part WHERE p_partkey % 2 = 1),
s AS (SELECT lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN '::cover-context:img' || p_size WHEN 1 THEN '' ELSE '::cover-context:img' || (p_size + 1) END AS key, 'ai' AS kind, p_partkey * 2 AS external_id, 1 AS result_rank, p_size AS age FROM part
UNION ALL SELECT lower(p_name), 'plain', p_partkey * 2 + k, k, p_size FROM part, (VALUES (1), (2), (3)) AS r(k)),
c AS (SELECT p_partkey AS external_id, lower(p_name) AS name, p_size AS year FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT p_partkey + 500 AS external_id, lower(p_name) AS name, p_size AS year FROM part WHERE p_partkey % 3 <> 1),
h AS (SELECT query_id, external_id, 1 AS level, 0 AS a, result_rank AS b FROM w JOIN s ON kind = 'ai' AND key = folded || '::cover-context:' || context
UNION ALL SELECT query_id, external_id, 2, age, result_rank FROM w JOIN s ON kind = 'ai' AND split_part(key, '::cover-context:', 1) = folded AND key LIKE '%::cover-context:%' AND key <> coalesce(folded || '::cover-context:' || context, '')
UNION ALL SELECT query_id, external_id, CASE kind WHEN 'ai' THEN 3 ELSE 4 END, 0, result_rank FROM w JOIN s ON key = folded
UNION ALL SELECT query_id, external_id, level, 0, b FROM (SELECT query_id, external_id, level, row_number() OVER (PARTITION BY query_id, level ORDER BY lower(query) <> name, year DESC NULLS LAST, external_id DESC) AS b
    FROM w JOIN (SELECT *, 5 AS level FROM c UNION ALL SELECT *, 6 FROM t) n ON name LIKE '%' || replace(folded, ' ', '%') || '%') WHERE b <= 20),
m AS (SELECT query_id, external_id, min((level, a, b)) AS m FROM h WHERE external_id > 0 GROUP BY ALL)
SELECT query_id, external_id, m[1] AS level, m[1] = 1 AS verified, row_number() OVER (PARTITION BY query_id ORDER BY m, external_id) AS rank FROM m"""


@query(CASCADE)
def search_caches(spark, sf):
    """Half of the catalogue's names with a picture as context and two words of the others, looked up in searches and names made of the catalogue."""
    part = tables.read(spark, sf, "part")
    key, name = F.col("p_partkey"), F.lower("p_name")
    short = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(3)))
    even = part.where("p_partkey % 2 = 0").select(key.alias("query_id"), F.col("p_name").alias("query"), name.alias("folded"), F.concat(F.lit("img"), "p_size").alias("context"))
    odd = part.where("p_partkey % 2 = 1").select(key.alias("query_id"), short.alias("query"), F.lower(short).alias("folded"), F.lit(None).cast("string").alias("context"))
    other = F.when(key % 4 == 0, F.concat(F.lit("::cover-context:img"), "p_size")).when(key % 4 == 1, "").otherwise(F.concat(F.lit("::cover-context:img"), F.col("p_size") + 1))
    at = F.timestamp_seconds(F.lit(10**9) - F.col("p_size"))
    by_ai = part.select(F.concat(name, other).alias("key"), F.lit("ai").alias("kind"), (key * 2).alias("external_id"), F.lit(1).alias("result_rank"), at.alias("updated_at"))
    plain = part.select(name.alias("key"), F.lit("plain").alias("kind"), F.explode(F.array(*[F.struct((key * 2 + k).alias("external_id"), F.lit(k).alias("result_rank")) for k in (1, 2, 3)])).alias("r"), at.alias("updated_at"))
    searches = by_ai.unionByName(plain.select("key", "kind", "r.*", "updated_at"))
    named = lambda more, rest: part.where(F.col("p_partkey") % 3 != rest).select((key + more).alias("external_id"), F.col("p_name").alias("name"), F.col("p_size").alias("year"))
    return match.search_cascade(even.unionByName(odd), searches, named(0, 0), named(500, 1))
