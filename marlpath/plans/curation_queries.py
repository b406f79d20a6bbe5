"""Curated links, translations, details, payloads, storefront answers and the rules of small tables, over the given ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.offers import item_type_of
from ..operators import curation, imports, match, monitor, predicates, schedule
from ..functions.classify import auto_confirmed, item_decision, video_score
from ..sources import pages, payloads, products, storefronts, tables
from ..sources.tables import SQL
from .binding import query
from .kernel_queries import kernel, spoken


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(SQL + """, old AS (SELECT id, id % 50 AS item_id, 'u' || id % 7 AS url FROM items WHERE id % 3 = 0), have AS (SELECT item_id, url, min(id) AS id FROM old GROUP BY ALL),
new AS (SELECT p_size AS item_id, 'u' || p_partkey % 7 AS url, max_by('title ' || p_partkey, p_partkey) AS title FROM part WHERE p_size IN (SELECT id FROM items) GROUP BY ALL),
fresh AS (SELECT *, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY item_id, url) AS id FROM new WHERE (item_id, url) NOT IN (SELECT (item_id, url) FROM have))
SELECT old.id, old.item_id, old.url, coalesce(new.title, 'old') AS title, CASE WHEN new.title IS NULL THEN 'HIDDEN' ELSE 'ACTIVE' END AS status FROM old LEFT JOIN have USING (id) LEFT JOIN new ON new.item_id = have.item_id AND new.url = have.url
UNION ALL SELECT id, item_id, url, title, 'ACTIVE' FROM fresh""")
def tutorial_links(spark, sf):
    items = tables.items(spark, sf)
    old = items.where("id % 3 = 0").select("id", (F.col("id") % 50).alias("item_id"), text("u", F.col("id") % 7).alias("url"), F.lit("old").alias("title"), F.lit("en").alias("language"), F.lit("x").alias("source"), F.lit("HIDDEN").alias("status"))
    new = tables.read(spark, sf, "part").select(F.col("p_size").cast("long").alias("item_id"), text("u", F.col("p_partkey") % 7).alias("url"), text("title ", F.col("p_partkey")).alias("title"), F.col("p_partkey").alias("pos"))
    return curation.links_after(old, items, new).select("id", "item_id", "url", "title", "status")


@query("""WITH j AS (SELECT event_id AS id, sha256('text ' || user_id % 40) AS h, CASE WHEN event_id % 3 = 0 THEN 'es' ELSE 'en' END AS s, CASE event_type WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts, 'done ' || event_id AS t FROM events),
b AS (SELECT h, s, max_by(t, (ts, id)) AS t FROM j WHERE status = 'COMPLETED' GROUP BY ALL)
SELECT p_partkey AS id, b.t AS translated_text FROM part LEFT JOIN b ON b.h = sha256('text ' || p_partkey % 50) AND b.s = CASE WHEN p_partkey % 2 = 0 THEN 'es' ELSE 'en' END""")
def cached_translations(spark, sf):
    events, key = tables.read(spark, sf, "events"), F.col("p_partkey")
    fixed = [F.lit(v).alias(n) for n, v in (("purpose", "title"), ("model", "m"), ("prompt_version", "1"))]
    jobs = events.select(
        F.col("event_id").alias("id"), F.sha2(text("text ", F.col("user_id") % 40), 256).alias("source_text_hash"), F.when(F.col("event_id") % 3 == 0, "es").otherwise("en").alias("source_language"), F.lit("fr").alias("target_language"),
        *fixed, F.when(F.col("event_type").isin("click", "view"), "COMPLETED").otherwise("FAILED").alias("status"), F.col("ts").alias("updated_at"), text("done ", F.col("event_id")).alias("translated_text"),
    )
    asked = tables.read(spark, sf, "part").select(key.alias("id"), text("  text ", key % 50, " ").alias("text"), F.when(key % 2 == 0, " ES").otherwise("En ").alias("source_language"), F.lit("FR").alias("target_language"), *fixed)
    return curation.cached_translations(asked, jobs).select("id", "translated_text")


@query("""WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 7 - 1 END AS a, p_size % 6 AS b, p_partkey % 4 AS c, CASE WHEN p_partkey % 3 = 0 THEN p_size % 3 + 0.5 ELSE p_size END AS d, p_partkey % 3 - 1 AS e FROM part),
o AS (SELECT id, CASE WHEN a >= 1 THEN a END AS lo, CASE WHEN b >= 1 THEN b END AS hi, CASE WHEN c >= 1 THEN c END AS n, CASE WHEN d = floor(d) AND d >= 1 THEN d END AS m, CASE WHEN e >= 0 THEN e END AS age FROM v),
p AS (SELECT *, coalesce(lo > hi, false) AS x FROM o), q AS (SELECT id, coalesce(CASE WHEN NOT x THEN lo END, n) AS lo, coalesce(CASE WHEN NOT x THEN hi END, m) AS hi, coalesce(age, 8) AS age FROM (SELECT p.*, coalesce(n > m, false) AS y FROM p) WHERE NOT y
    UNION ALL SELECT id, CASE WHEN NOT x THEN lo END, CASE WHEN NOT x THEN hi END, coalesce(age, 8) FROM (SELECT p.*, coalesce(n > m, false) AS y FROM p) WHERE y)
SELECT id, CAST(CASE WHEN coalesce(lo > hi, false) THEN NULL ELSE lo END AS INT) AS min_players, CAST(CASE WHEN coalesce(lo > hi, false) THEN NULL ELSE hi END AS INT) AS max_players, CAST(age AS INT) AS min_age FROM q""")
def merged_details(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("double")
    made = tables.read(spark, sf, "part").select(
        key.alias("id"), F.when(key % 5 != 0, key % 7 - 1).alias("old_min_players"), (size % 6).alias("old_max_players"), (key % 4).alias("new_min_players"),
        F.when(key % 3 == 0, size % 3 + 0.5).otherwise(size.cast("double")).alias("new_max_players"), (key % 3 - 1).alias("old_min_age"), F.lit(8).alias("new_min_age"),
        *[none.alias(f"{k}_{b}_minutes") for k in ("old", "new") for b in ("min", "max")],
    )
    return curation.merged_details(made).select("id", "min_players", "max_players", "min_age")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn, role) AS r FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) WHERE trim(text) <> '') WHERE r = 1""")
def first_spellings(spark, sf):
    rows = tables.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").distinct().withColumn("pos", F.struct("turn", "role"))
    return curation.first_spellings(rows, ["conv_id"], F.lower(F.trim("text")), "pos").select("conv_id", "turn", "role")


@query("""WITH v AS (SELECT user_id AS item_id, 'v' || event_id % 40 AS video_id, event_id AS pos, CAST(value AS INT) % 5 AS score, event_id % 7 AS likes, 'u' || event_id AS url FROM events),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY item_id, video_id ORDER BY pos) = 1)
SELECT item_id, video_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, likes DESC, url) AS rank FROM o""")
def ranked_videos(spark, sf):
    key = F.col("event_id")
    made = tables.read(spark, sf, "events").select(F.col("user_id").alias("item_id"), text("v", key % 40).alias("video_id"), key.alias("pos"), (F.bround("value", 0).cast("int") % 5).alias("score"), (key % 7).alias("likes"), text("u", key).alias("url"))
    return curation.ranked_videos(made).select("item_id", "video_id", "rank")


@query("""SELECT p_partkey AS id, 'name' AS path, 'n ' || p_name AS value FROM part UNION ALL SELECT p_partkey, 'tags.[0]', p_brand FROM part UNION ALL SELECT p_partkey, 'tags.[1]', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT p_partkey, 'self', NULL FROM part UNION ALL SELECT p_partkey, 'tags.[2]', NULL FROM part UNION ALL SELECT p_partkey, 'far', NULL FROM part UNION ALL SELECT p_partkey, 'none', '[]' FROM part UNION ALL SELECT p_partkey, 'inner.name', 'n ' || p_name FROM part""")
def payload_values(spark, sf):
    """A payload of each part: an object of places, a list among them that leads back, a place beyond the end, and an object in an object."""
    part = tables.spread(tables.read(spark, sf, "part"), "p_partkey")
    made = text('[{"name": 2, "tags": 1, "self": 0, "far": 99, "none": 5, "inner": 6}, [3, 4, 1], "n ', F.col("p_name"), '", "', F.col("p_brand"), '", ', F.col("p_size"), ', [], {"name": 2}, true]')
    found = payloads.values(part.select(F.col("p_partkey").alias("id"), made.alias("payload")))
    return found.select("id", F.array_join("path", ".").alias("path"), "value")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'about ' || p_name WHEN 1 THEN '<p>Número de jugadores: 2</p>' ELSE '' END AS description FROM part""")
def payload_descriptions(spark, sf):
    key = F.col("p_partkey")
    slug = text("game-", key)
    body = (
        F.when(key % 4 == 0, text('[1, {"slug": 2, "description": 3}, "', F.upper(slug), '", " about ', F.col("p_name"), ' ", "<p>Edad recomendada</p>", {"slug": 4, "description": 3}]'))
        .when(key % 4 == 1, text('[{"slug": 1, "description": 2}, "other", "not this", "<p>Número de jugadores: 2</p>"]'))
        .when(key % 4 == 2, '["<p>Edad recomendada</p>", "<b>NUMERO de jugadores</b>"]').otherwise("{bad")
    )
    return payloads.product_descriptions(tables.read(spark, sf, "part").select(key.alias("id"), slug.alias("slug"), body.alias("payload")))


@query("""SELECT p_partkey AS source_id, p_name AS title, CAST(CAST(p_size + 0.5 AS DECIMAL(12, 2)) AS VARCHAR) AS price, CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'MXN' END AS currency,
    CASE WHEN p_partkey % 2 = 0 THEN 'available' ELSE 'out_of_stock' END AS availability, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 's' || p_partkey END AS store_sku FROM part WHERE p_partkey % 7 <> 0""")
def storefront_answers(spark, sf):
    key = F.col("p_partkey")
    sku = F.when(key % 5 == 0, "[]").otherwise(text('[{"sku": "s', key, '"}, {"sku": "no"}]'))
    body = text('{"data": {"product": {"title": " ', F.when(key % 7 == 0, "").otherwise(F.col("p_name")), '", "vendor": null, "availableForSale": ', F.when(key % 2 == 0, "true").otherwise("false"), ', "priceRange": {"minVariantPrice": {"amount": "', F.col("p_size") + F.lit(0.5), '", "currencyCode": "', F.when(key % 3 == 0, "USD").otherwise(""), '"}}, "variants": {"nodes": ', sku, "}}}}")
    found = storefronts.storefront_products(tables.read(spark, sf, "part").select(F.lit(1).alias("store_id"), key.cast("string").alias("url"), body.alias("body")))
    return found.select(F.col("source_url").cast("long").alias("source_id"), "title", F.col("price").cast("decimal(12,2)").cast("string").alias("price"), "currency", "availability", "store_sku")


@query("""WITH k AS (SELECT s_suppkey AS store_id, unnest(['short page', 'total changed', 'keys missing', NULL])AS f, s_suppkey % 4 AS n FROM supplier)
SELECT DISTINCT store_id, CASE n WHEN 0 THEN 'short page' WHEN 1 THEN 'total changed' ELSE 'keys missing' END AS fault FROM k WHERE n < 3""")
def catalogue_pages(spark, sf):
    """Three pages of two products and one of one for each store, as JSON; one store in four has a short page in between, changing totals, or a product twice."""
    n = F.col("store_id") % 4
    product = lambda k: text('{"id": "', k, '", "name": "x", "price": "1,200.5", "in_stock": true}')
    page = tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id")).withColumn("page", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])))
    p = F.col("page")
    second = F.when((n == 2) & (p == 2), F.lit(10)).otherwise(p * 10 + 1)
    full = F.concat_ws(",", product(p * 10), F.when(~((n == 0) & (p == 1)) & (p < 3), product(second)))
    total = F.when(n == 0, 4).when((n == 1) & (p == 2), 6).otherwise(5)
    body = text('{"products": [', full, '], "total": ', total, ', "page": ', p, ', "per_page": 2}')
    return pages.catalogue_faults(storefronts.catalogue_products(page.select("store_id", body.alias("body"))))


@query("""WITH p AS (SELECT p_size % 4 AS store_id, p_partkey, p_name, p_size, p_brand FROM part)
SELECT 'row' AS kind, store_id, 'https://s.mx/product/p%20' || p_partkey AS url, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN p_size || '.5' ELSE CAST(p_size AS VARCHAR) END AS price,
    CASE WHEN p_partkey % 3 = 0 THEN 'out_of_stock' WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'available' WHEN p_size % 2 = 0 THEN 'out_of_stock' ELSE 'available' END AS availability FROM p WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'fault', 1, 'products missing', NULL, NULL WHERE EXISTS (SELECT 1 FROM p WHERE store_id = 1) UNION ALL SELECT 'fault', 9, 'invalid response', NULL, NULL UNION ALL SELECT 'fault', 8, 'another page', NULL, NULL""")
def whole_catalogues(spark, sf):
    """The parts as four stores' products, ten a page; one store says one product too many, and two more give no catalogue."""
    part, key, size = tables.read(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    price = F.when(size % 5 == 0, "null").when(size % 2 == 0, text('"', size, '.50"')).otherwise(size.cast("string"))
    online, stock = F.when(key % 3 == 0, "false").when(key % 4 == 1, "true").otherwise("null"), F.when((key % 4 < 2), "null").when(size % 2 == 0, "0").otherwise("2")
    one = text('{"id": "', key, '", "name": " ', F.when(key % 7 == 0, "").otherwise(F.col("p_name")), '", "slug": "/p ', key, '/", "price": ', price, ', "brand": "x", "availableOnline": ', online, ', "stock": ', stock, "}")
    numbered = part.select((size % 4).alias("store_id"), key.alias("k"), one.alias("one")).withColumn("place", F.row_number().over(Window.partitionBy("store_id").orderBy("k")) - 1)
    totals = numbered.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    page = numbered.groupBy("store_id", F.floor(F.col("place") / 10).alias("page")).agg(F.array_join(F.collect_list("one"), ", ").alias("own")).join(totals, "store_id")
    body = text('{"content": [', F.col("own"), '], "number": ', F.col("page"), ', "totalPages": ', F.ceil(F.col("n") / 10), ', "totalElements": ', F.col("n") + F.when(F.col("store_id") == 1, 1).otherwise(0), "}")
    other = spark.range(8, 10).select(F.col("id").cast("int").alias("store_id"), F.lit(0).cast("long").alias("page"), F.when(F.col("id") == 8, '{"content": [], "number": 1, "totalPages": 1, "totalElements": 0}').otherwise('{"content": 3}').alias("body"))
    rows, faults = storefronts.whole_catalogue(page.select("store_id", "page", body.alias("body")).unionByName(other).withColumn("store_url", F.lit("https://s.mx/tienda")))
    none = F.lit(None).cast("string")
    found = rows.select(F.lit("row").alias("kind"), "store_id", F.col("source_url").alias("url"), "price", "availability")
    return found.unionByName(faults.select(F.lit("fault").alias("kind"), "store_id", F.col("fault").alias("url"), none.alias("price"), none.alias("availability")))


@query("""SELECT 'row' AS kind, CAST(p_partkey AS VARCHAR) AS sku, min(p_size % 3) AS category, min(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || '.50' END) AS price,
    min(CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'out_of_stock' ELSE 'available' END) AS availability FROM part WHERE p_partkey % 11 <> 0 GROUP BY p_partkey
UNION ALL SELECT 'fault', f, NULL, NULL, NULL FROM (VALUES ('unavailable'), ('another domain'), ('incomplete product'), ('another product''s address')) v(f)
WHERE f = 'unavailable' OR EXISTS (SELECT 1 FROM part WHERE p_partkey % 11 = 0 AND p_partkey // 11 % 3 = CASE f WHEN 'another domain' THEN 0 WHEN 'incomplete product' THEN 1 ELSE 2 END)""")
def category_catalogues(spark, sf):
    """The parts in two categories each of one store, one page a part and category; every eleventh has a fault, and one page wasn't ready."""
    part, key, size = tables.spread(tables.read(spark, sf, "part"), "p_partkey"), F.col("p_partkey"), F.col("p_size")
    fault = F.when(key % 11 == 0, F.floor(key / 11) % 3)
    link = F.when(fault == 0, text("https://other.mx/", key, "-x.html")).when(fault == 2, text("https://www.s.mx/a/9", key, "-x.html")).otherwise(text("https://www.s.mx/a/", key, "-X.HTML?q=1"))
    one = text(
        '{"status": true, "total": 5, "items": [{"id_product": ', key, ', "name": "', F.when(fault == 1, " ").otherwise(F.col("p_name")), '", "link": "', link, '", "price_amount": ', F.when(key % 3 == 0, '"-1"').otherwise(text(size, ".5")),
        ', "stock": ', F.when(key % 4 == 0, "null").when(key % 4 == 1, "0").otherwise('"3"'), "}]}",
    )
    pages_of = part.select(F.explode(F.array(size % 3, size % 3 + 3)).alias("category"), key.alias("page"), one.alias("body"))
    bad = spark.range(1).select(F.lit(7).alias("category"), F.lit(0).cast("long").alias("page"), F.lit('{"status": false, "items": [], "total": 0}').alias("body"))
    rows, faults = storefronts.category_catalogue(pages_of.unionByName(bad).withColumns({"store_id": F.lit(1), "store_url": F.lit("https://s.mx/")}))
    none = F.lit(None).cast("string")
    found = rows.select(F.lit("row").alias("kind"), F.col("store_sku").alias("sku"), "category", "price", "availability")
    return found.unionByName(faults.select(F.lit("fault").alias("kind"), F.col("fault").alias("sku"), F.lit(None).cast("int").alias("category"), none.alias("price"), none.alias("availability")))


@query(SQL + """, q AS (SELECT DISTINCT 'k' || id % 9 AS query_key FROM items)
SELECT query_key, CAST(CASE WHEN query_key IN ('k1', 'k2') THEN 1 ELSE 3 END AS BIGINT) AS n, query_key IN ('k1', 'k2') AS fresh FROM q""")
def replaced_results(spark, sf):
    """A search cache in which two queries were asked again: these have their new result alone."""
    keys = tables.items(spark, sf).select(text("k", F.col("id") % 9).alias("query_key")).distinct()
    old = keys.select("query_key", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("rank"), F.lit(7).alias("external_id"))
    again = keys.where("query_key in ('k1', 'k2')")
    queries, results = imports.replace_results(keys.withColumn("searched_at", F.lit(1)), old, again.withColumn("searched_at", F.lit(2)), again.select("query_key", F.lit(1).alias("rank"), F.lit(9).alias("external_id")))
    found = results.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"), F.max("external_id").alias("e"))
    return queries.join(found, "query_key").select("query_key", "n", ((F.col("searched_at") == 2) & (F.col("e") == 9)).alias("fresh"))


@query("""WITH s AS (SELECT conv_id AS query, turn AS pos, (turn * 7 + conv_id) % 6 - 1 AS external_id, turn % 3 = 0 AS exact FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
o AS (SELECT * FROM s WHERE external_id > 0 QUALIFY row_number() OVER (PARTITION BY query, external_id ORDER BY exact DESC, pos) = 1)
SELECT query, external_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, pos) AS rank FROM o) WHERE rank <= 3""")
def prioritised_searches(spark, sf):
    made = tables.read(spark, sf, "conversations").select("conv_id", "turn").distinct()
    made = made.select(F.col("conv_id").alias("query"), F.col("turn").alias("pos"), ((F.col("turn") * 7 + F.col("conv_id")) % 6 - 1).alias("external_id"), (F.col("turn") % 3 == 0).alias("exact"))
    return match.prioritised(made, 3).select("query", "external_id", "rank")


@query(SQL + """, p AS (SELECT TIMESTAMP '2000-01-01' AS since, 90000::DECIMAL(12, 2) AS dear, ['LISTED', 'PENDING'] AS states)
SELECT s.id, s.price > p.dear AS dear FROM store_items s, p WHERE s.last_updated >= p.since AND list_contains(p.states, s.listing_status)""")
def parameter_relation(spark, sf):
    given = curation.parameters(spark, since=F.lit("2000-01-01").cast("timestamp"), dear=F.lit(90000).cast("decimal(12,2)"), states=F.array(F.lit("LISTED"), F.lit("PENDING")))
    found = tables.store_items(spark, sf).join(F.broadcast(given), F.col("last_updated") >= F.col("since"))
    return found.where(F.array_contains("states", F.col("listing_status"))).select("id", (F.col("price") > F.col("dear")).alias("dear"))


@query(SQL + """, own AS (SELECT id FROM items WHERE id % 50 = 0), rel AS (SELECT p_partkey AS a, (p_partkey * 13) % (SELECT count(*) FROM part) + 1 AS b FROM part WHERE p_partkey % 11 = 0)
SELECT 'listings' AS name, count(*) AS n FROM store_items WHERE item_id IN (SELECT id FROM own) UNION ALL SELECT 'relationships', count(*) FROM rel WHERE a IN (SELECT id FROM own) OR b IN (SELECT id FROM own)
UNION ALL SELECT 'brands', count(*) FROM items WHERE id IN (SELECT id FROM own)""")
def deletion_counts(spark, sf):
    from .catalog_queries import relationships

    items = tables.items(spark, sf)
    held = {"listings": tables.store_items(spark, sf), "relationships": relationships(spark, sf), "brands": items.select(F.col("id").alias("item_id"), "brand")}
    keys = {"listings": ["item_id"], "relationships": ["item_a_id", "item_b_id"], "brands": ["item_id"]}
    return curation.deletion_counts(held, items.where("id % 50 = 0").select(F.col("id").alias("item_id")), keys)


@query("""SELECT page_id, CAST(count(*) AS BIGINT) AS links, min(u) AS first_url, min(a) AS availability FROM (
    SELECT page_id, 'https://shop.mx/products/p-' || (page_id + k) AS u, CASE WHEN page_id % 2 = 0 THEN 'out_of_stock' ELSE 'available' END AS a FROM pages, (VALUES (1000), (1001)) v(k)) GROUP BY 1""")
def listing_candidates(spark, sf):
    """Listing pages made of the pages: two products, one of them twice, and two links that are none."""
    key = F.col("page_id")
    stock = F.when(key % 2 == 0, "Agotado").otherwise("Agregar al carrito")
    one = lambda k: text('<div><a href="/products/p-', key + k, '?x=1">Game ', key + k, "</a><span>$ 1,200.00</span><b>", stock, "</b></div>")
    html = text('<a href="/contacto">Contacto</a>', one(1000), one(1001), one(1000), '<a href="https://shop.mx/blog/x">Blog</a>')
    found = pages.listing_candidates(tables.read(spark, sf, "pages").select("page_id", F.lit("https://shop.mx/all").alias("url"), html.alias("html")))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("source_url").alias("first_url"), F.min("availability").alias("availability"))


@query("""SELECT event_id, CAST(CASE WHEN extract(hour FROM l) * 3600 + extract(minute FROM l) * 60 + extract(second FROM l) < 5 * 3600 THEN date_trunc('day', l) ELSE date_trunc('day', l) + INTERVAL 1 DAY END + INTERVAL 11 HOUR AS TIMESTAMP) AS next_at
FROM (SELECT event_id, ts - INTERVAL 6 HOUR AS l FROM events)""")
def next_local_times(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", schedule.next_local_time(F.col("ts").cast("timestamp")).alias("next_at"))


@query("""WITH c AS (SELECT n_nationkey AS pos, n_name AS name FROM nation), s AS (SELECT r_regionkey AS pos, r_name AS name FROM region),
t AS (SELECT 0 AS part, r_regionkey AS pos, 0 AS n, 'Comprar juegos de mesa ' || r_name AS text FROM region WHERE r_regionkey < 3 UNION ALL SELECT 1, pos, 0, 'tienda juegos de mesa ' || name || ' mexico' FROM c UNION ALL SELECT 1, pos, 1, 'juegos de mesa tienda online ' || name FROM c
    UNION ALL SELECT 2, pos, 0, 'tienda juegos de mesa ' || name || ' mexico' FROM s UNION ALL SELECT 2, pos, 1, 'comprar juegos de mesa ' || name FROM s)
SELECT text, row_number() OVER (ORDER BY part, pos, n) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY part, pos, n) AS r FROM t) WHERE r = 1""")
def store_search_texts(spark, sf):
    """Nations as cities and regions as states; some core texts are those of a state in other letters."""
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    core = region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("pos"), text("Comprar juegos de mesa ", F.col("r_name")).alias("text"))
    found = curation.search_texts(core, nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")), region.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name")), "full")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos"))  # a list of some hundred texts
    return found.select("text", place.alias("place"))


@query("""SELECT '{"id":' || id || ',"status":"' || status || '"}' AS row FROM (SELECT event_id AS id, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)""")
def latest_attempt_json(spark, sf):
    made = tables.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), "ts")
    return monitor.latest_as_json(made.orderBy(F.desc("ts"), F.desc("id")).limit(1).select("id", "status"), F.desc("id"))


@query("""SELECT event_id, CAST(greatest(0, round(6 * (CASE WHEN n1 THEN 1 ELSE 0 END + CASE WHEN n2 THEN 1 ELSE 0 END) + 2 * (CASE WHEN n1 THEN 1 ELSE 0 END + CASE WHEN n2 THEN 1 ELSE 0 END) + CASE k WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE -2.5 END + least(4, log10(likes + 1)), 1)) AS DECIMAL(6, 1)) AS score FROM (
    SELECT event_id, event_id % 2 = 0 AS n1, event_id % 3 = 0 AS n2, event_id % 4 AS k, 10 ** (event_id % 3) - 1 AS likes FROM events)""")
def video_scores(spark, sf):
    """Captions of events that name an item in one or both of its languages, with a sign each."""
    key = F.col("event_id")
    sign = F.when(key % 4 == 0, "tutorial").when(key % 4 == 1, "aprende").when(key % 4 == 2, "conoce").otherwise("unboxing")
    caption = F.concat_ws(" ", F.when(key % 2 == 0, "azul"), F.when(key % 3 == 0, "blue"), sign)
    names = F.array(F.lit("azul"), F.lit("blue"), F.lit(""))
    likes = F.when(key % 3 == 0, 0).when(key % 3 == 1, 9).otherwise(99)
    return tables.read(spark, sf, "events").select("event_id", video_score(caption, names, F.array(F.lit("azul"), F.lit("blue")), likes).cast("decimal(6,1)").alias("score"))


#: Kernels over stated texts.
kernel("item_types", lambda t, u: item_type_of(t, u), (("Catan expansión", "u"), "expansion"), (("Catan", "https://a.mx/expansiones/1"), "expansion"), (("Catan", None), "unknown"))
kernel("kept_titles", lambda a, b, c: products.refreshed_title(a, b, c), (("Mine", "Shop", " Shop "), "Mine"), (("Mine", "Shop", "New "), "New"), (("Mine", "", "Mine"), "Mine"))
kernel("confirmed_items", lambda t, p: auto_confirmed(item_decision(t, p, F.lit(False), F.lit(False), F.lit(False))), (("paint brush", ""), "true"), (("paint", ""), "false"), (("juego de mesa", "devir"), "false"))
kernel("brand_bylines", lambda a, b: F.concat_ws("|", storefronts.brand_of_byline(a), storefronts.brand_matches(a, b)), (("Marca: Devir", "DEVIR"), "Devir|true"), (("Visita la tienda de  Asmodee", "Devir"), "Asmodee|false"), (("Visit the Z-Man Store", "z man"), "Z-Man|true"), (("X", ""), "X|false"))
kernel("marketplace_facts", lambda v: F.concat_ws("|", storefronts.number_range(v)["min"], storefronts.number_range(v)["max"], storefronts.age_in_years(v)), (("2 a 4",), "2|4|2"), (("36 meses",), "36|36|3"), (("120",), "120|120|10"), (("8 años",), "8|8|8"), (("x",), ""))
kernel("buy_boxes", lambda p, c: F.concat_ws("|", storefronts.buy_box(p, c == "yes")["price"], storefronts.buy_box(p, c == "yes")["availability"]), (("9.50", "yes"), "9.50|available"), (("9.50", "no"), "|out_of_stock"), (("9.50", None), "|out_of_stock"))
kernel("words_in_order", lambda t: predicates.in_order(t, ["ca%", "an"]), (("xCA% y AN",), "true"), (("caxx an",), "false"), (("an ca%",), "false"))
kernel("texts_contained", lambda t: predicates.contains_fold(t, "50%_"), (("a 50%_B",), "true"), (("50 x",), "false"), ((None,), "false"))
kernel("video_users", lambda u: F.concat_ws("/", curation.video_identity(u)["user"], curation.video_identity(u)["video_id"]), (("https://www.tiktok.com/@ludo/video/123?x=1",), "ludo/123"), (("https://tiktok.com/@a/photo/1",), ""), (("https://a.mx/@a/video/1",), ""), (("https://m.tiktok.com/x/@b/video/9/",), "b/9"))
kernel("texts_without_nul", lambda j: curation.json_without_nul(j), (('{"a\\u0000b": ["x\\u0000\\u0000y"]}',), '{"ab": ["xy"]}'), (('"a\\\\u0000"',), '"a\\\\u0000"'), ((None,), None))


def price_pair(v):
    return F.struct(F.col(f"{v}_raw").alias("raw_price"), F.col(v).alias("price"), F.lit(v).alias("price_source"), F.col(f"{v}_stock").alias("availability"), F.lit(v).alias("availability_source"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN 'd' WHEN p_partkey % 4 = 0 AND p_partkey % 5 = 0 THEN 'd' ELSE 'l' END AS price_source, CASE WHEN p_partkey % 4 = 1 THEN 'l' ELSE 'd' END AS availability_source FROM part""")
def listing_fallbacks(spark, sf):
    """A detail without a price in one of three cases, out of stock in one of four and unknown in another, with no way to buy in one of five."""
    key = F.col("p_partkey")
    made = tables.read(spark, sf, "part").select(
        key.alias("id"), F.when(key % 3 > 0, "9").otherwise("").alias("d"), F.lit("$9").alias("d_raw"), F.when(key % 4 == 0, "out_of_stock").when(key % 4 == 1, "unknown").otherwise("available").alias("d_stock"),
        F.lit("8").alias("l"), F.lit("$8").alias("l_raw"), F.lit("available").alias("l_stock"), F.when(key % 5 == 0, False).alias("buyable"),
    )
    found = curation.listing_fallbacks(price_pair("d"), price_pair("l"), F.col("buyable"))
    return made.withColumn("f", found).select("id", "f.price_source", "f.availability_source")
