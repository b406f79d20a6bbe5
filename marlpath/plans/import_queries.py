"""Imports of external records, as XML made of the catalogue, with all that they link to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_title
from ..operators import importing
from ..schemas import conform
from ..sources import records, tables
from ..sources.tables import SQL
from .binding import query

AS_OF = "2024-06-30"
FULL_ITEMS = (
    "id bigint, canonical_name string, normalized_name string, item_type string, parent_item_id bigint, bgg_id bigint, bgg_last_sync_at timestamp, year_published int, "
    "rating decimal(8,2), weight decimal(8,2), min_players int, max_players int, min_minutes int, max_minutes int, min_age int"
)


def record_documents(spark, sf):
    """An XML record of each part: names encoded twice, links in either order of attributes, every 37th cut off."""
    part = tables.spread(tables.read(spark, sf, "part"), "p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def link(kind, number, name, inbound=None):
        near = text('<link type="', kind, '" id="', number, '" value="', name, '"', F.when(inbound, ' inbound="true"').otherwise("") if inbound is not None else "", "/>")
        far = text('<link value="', name, '"', F.when(inbound, ' inbound="true"').otherwise("") if inbound is not None else "", ' id="', number, '" type="', kind, '"/>')
        return F.when(key % 2 == 0, near).otherwise(far)

    name = F.concat("p_name", F.when(key % 5 == 0, " &amp;amp; Co").otherwise(""))
    other = text("mech ", size % 10, F.when(key % 2 == 0, " a").otherwise(" b"))
    to = F.floor(key / 2)
    implementation = F.when(key == 1, link("boardgameimplementation", F.lit(100008), F.lit("thing"))).when(key % 4 != 3, link("boardgameimplementation", to + 100000, F.lit("thing"), key % 2 == 0)).otherwise("")
    parent = F.when(size % 7 == 0, link("boardgameexpansion", F.floor(key / 3) + 100000, F.lit("thing"), F.lit(True))).otherwise(link("boardgameexpansion", key + 100001, F.lit("thing")))
    parts = [
        link("boardgamecategory", size + 1000, text("cat ", size)), link("boardgamemechanic", size % 10 + 1, other), link("boardgamefamily", F.lit(0), F.lit("no id")),
        link("boardgamedesigner", key % 50 + 1, text("Person ", key % 50)), link("boardgameartist", key % 30 + 1, text("Person ", key % 30)),
        link("boardgamepublisher", key % 20 * 10 + key % 3, text("House ", key % 20)), implementation, parent,
    ]
    head = F.when(size % 7 == 0, text('<items><item type="boardgameexpansion" id="', key + 100000, '">')).otherwise(text('<items><item id="', key + 100000, '" type="boardgame">'))
    names = text('<name value="Alt &#101;&amp;eacute; ', F.col("p_name"), '" type="alternate"/><name type="primary" value="', name, '"/>', F.when(key % 2 == 0, text('<name type="alternate" value="ALT e&#233; ', F.upper("p_name"), '"/>')).otherwise(""))
    facts = text('<yearpublished value="', size + 1990, '"/><minplayers value="', size % 4 + 1, '"/><maxplayers value="x"/><playingtime value="30"/><minplaytime value="', F.when(size % 2 == 0, "20").otherwise(""), '"/>')
    rates = text('<statistics><ratings><average value="', F.round(size / 7, 2), '"/><averageweight value="2.5"/></ratings></statistics>')
    whole = text(head, names, facts, *parts, rates, "</item></items>")
    return part.select((key + 100000).alias("external_id"), F.when(key % 37 == 0, F.substring(whole, F.lit(1), F.length(whole) - 30)).otherwise(whole).alias("xml"))


@query("""SELECT p_partkey + 100000 AS external_id, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' & Co' ELSE '' END AS name, CASE WHEN p_size % 7 = 0 THEN 'boardgameexpansion' ELSE 'boardgame' END AS kind,
    'Alt eé ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|ALT eé ' || upper(p_name) ELSE '' END AS alternates, p_size % 4 + 1 AS min_players, NULL::INT AS max_players,
    CASE WHEN p_size % 2 = 0 THEN 20 ELSE 30 END AS min_minutes, round(p_size / 7, 2) AS rating, CASE WHEN p_partkey = 1 OR p_partkey % 4 <> 3 THEN 7 ELSE 6 END - CASE WHEN p_partkey % 60 = 0 THEN 1 ELSE 0 END AS links,
    CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey <> 1 AND p_partkey % 4 <> 3 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS inbound
FROM part WHERE p_partkey % 37 <> 0""")
def xml_records(spark, sf):
    found = records.things(record_documents(spark, sf))
    return found.select(
        "external_id", "name", "kind", F.array_join("alternate_names", "|").alias("alternates"), "min_players", "max_players", "min_minutes", "rating",
        F.size("links").alias("links"), F.size(F.filter("links", lambda k: k["inbound"])).alias("inbound"),
    )


@query("""SELECT p_partkey + 100000 AS bgg_id, CASE WHEN p_partkey = 1 THEN 100008 ELSE p_partkey // 2 + 100000 END AS linked_bgg_id, 'implementation' AS link_type, p_partkey <> 1 AND p_partkey % 2 = 0 AS inbound FROM part WHERE p_partkey % 37 <> 0 AND (p_partkey = 1 OR p_partkey % 4 <> 3)
UNION ALL SELECT p_partkey + 100000, CASE WHEN p_size % 7 = 0 THEN p_partkey // 3 + 100000 ELSE p_partkey + 100001 END, 'extension', p_size % 7 = 0 FROM part WHERE p_partkey % 37 <> 0""")
def related_records(spark, sf):
    return records.related(records.things(record_documents(spark, sf))).select("bgg_id", "linked_bgg_id", "link_type", "inbound")


def state(spark, sf):
    """The tables before the import: items of which a quarter is fresh, lookups made of regions, publishers made of nations, and a few edges."""
    items, at = tables.items(spark, sf), F.lit(AS_OF).cast("timestamp")
    synced = F.when(F.col("id") % 4 == 0, at - F.expr("INTERVAL 10 DAY")).otherwise(at - F.expr("INTERVAL 200 DAY"))
    region, nation = tables.read(spark, sf, "region"), tables.read(spark, sf, "nation")
    number = F.col("n_nationkey").cast("long")
    none = lambda ddl: spark.createDataFrame([], ddl)
    bgg = F.when(number % 3 == 0, None).when(number % 3 == 1, number * 10).otherwise(number + 7000)
    edges = tables.read(spark, sf, "part").where("p_partkey % 6 = 0 and p_partkey > 0").select(F.floor(F.col("p_partkey") / 2).alias("item_a_id"), F.lit("implementation").alias("link_type"), F.col("p_partkey").alias("item_b_id"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("source_ref"))
    key = F.col("r_regionkey").cast("long") + 1
    return {
        "items": conform(items.withColumn("bgg_last_sync_at", synced), FULL_ITEMS), "aliases": none("item_id long, alias string, normalized_alias string"),
        "lookups": region.select(F.lit("mechanic").alias("kind"), key.alias("id"), key.alias("bgg_id"), F.col("r_name").alias("name")), "item_lookups": none("kind string, item_id long, lookup_id long"),
        "contributors": none("id long, bgg_id long, name string"), "item_contributors": none("item_id long, contributor_id long, role string"),
        "publishers": nation.select((number + 1).alias("id"), F.concat(F.lit("House "), number.cast("string")).alias("name"), F.lit("old").alias("normalized_name"), bgg.alias("bgg_id")),
        "item_publishers": none("item_id long, publisher_id long"), "relationships": edges,
    }


IMPORTED = "WITH RECURSIVE " + SQL.strip().removeprefix("WITH") + """, n AS (SELECT count(*) AS n FROM part), things AS (SELECT p_partkey AS p, p_partkey + 100000 AS x, * FROM part WHERE p_partkey % 37 <> 0),
own AS (SELECT id, bgg_id - 100000 AS p, id % 4 = 0 AS fresh FROM items WHERE bgg_id IS NOT NULL), fresh AS (SELECT p FROM own WHERE fresh),
el AS (SELECT p, CASE WHEN p = 1 THEN 8 ELSE p // 2 END AS q, 'implementation' AS t, p <> 1 AND p % 2 = 0 AS inb, 6 AS pos FROM things WHERE p = 1 OR p % 4 <> 3
    UNION ALL SELECT p, p // 3, 'extension', true, CASE WHEN p = 1 OR p % 4 <> 3 THEN 7 ELSE 6 END FROM things WHERE p_size % 7 = 0),
walk(p, level) AS (SELECT p, 0 FROM things WHERE p % 10 = 0 AND p NOT IN (SELECT p FROM fresh)
    UNION SELECT el.q, level + 1 FROM walk JOIN el USING (p) JOIN things t ON t.p = el.q WHERE level < 40 AND el.q NOT IN (SELECT p FROM fresh)),
taken AS (SELECT p, min(level) AS level FROM walk GROUP BY p),
ids AS (SELECT p, id FROM own UNION ALL SELECT p, (SELECT max(id) FROM items) + row_number() OVER (ORDER BY p) FROM taken WHERE p NOT IN (SELECT p FROM own)),
seen AS (SELECT things.*, level, id FROM things JOIN taken USING (p) JOIN ids USING (p)),
links AS (SELECT id AS item_id, level, p, 'category' AS kind, p_size + 1000 AS bgg, 'cat ' || p_size AS name FROM seen
    UNION ALL SELECT id, level, p, 'mechanic', p_size % 10 + 1, 'mech ' || p_size % 10 || CASE WHEN p % 2 = 0 THEN ' a' ELSE ' b' END FROM seen
    UNION ALL SELECT id, level, p, 'person', p % 50 + 1, 'Person ' || p % 50 FROM seen UNION ALL SELECT id, level, p, 'person', p % 30 + 1, 'Person ' || p % 30 FROM seen
    UNION ALL SELECT id, level, p, 'house', p % 20 * 10 + p % 3, 'House ' || p % 20 FROM seen WHERE p % 20 * 10 + p % 3 > 0),
named AS (SELECT kind, bgg, arg_min(name, (level, p)) AS name, min((level, p)) AS turn FROM links GROUP BY ALL),
lookups AS (SELECT 'mechanic' AS kind, r_regionkey + 1 AS id, r_regionkey + 1 AS bgg, coalesce(name, r_name) AS name FROM region LEFT JOIN named ON kind = 'mechanic' AND bgg = r_regionkey + 1
    UNION ALL SELECT kind, CASE kind WHEN 'mechanic' THEN (SELECT max(r_regionkey) + 1 FROM region) ELSE 0 END + row_number() OVER (PARTITION BY kind ORDER BY bgg), bgg, name FROM named
        WHERE kind IN ('category', 'person') OR kind = 'mechanic' AND bgg NOT IN (SELECT r_regionkey + 1 FROM region)),
known AS (SELECT n_nationkey + 1 AS id, 'House ' || n_nationkey AS name, CASE n_nationkey % 3 WHEN 1 THEN n_nationkey * 10 WHEN 2 THEN n_nationkey + 7000 END AS bgg FROM nation),
house AS (SELECT bgg, name, turn FROM named WHERE kind = 'house'), house_of AS (SELECT h.bgg, coalesce(a.id, b.id) AS id FROM house h LEFT JOIN known a ON a.bgg = h.bgg LEFT JOIN known b ON b.name = h.name),
adopted AS (SELECT b.id, arg_min(h.bgg, h.turn) AS bgg FROM house h JOIN known b ON b.name = h.name WHERE h.bgg NOT IN (SELECT bgg FROM known WHERE bgg IS NOT NULL) GROUP BY b.id),
reach AS (SELECT p FROM things UNION SELECT p FROM fresh),
edges AS (SELECT CASE WHEN inb THEN s.id ELSE l.id END AS a, t, CASE WHEN inb THEN l.id ELSE s.id END AS b, CAST(q + 100000 AS VARCHAR) AS ref, (s.level, s.p, pos) AS turn
    FROM el JOIN seen s USING (p) JOIN ids l ON l.p = el.q WHERE el.q IN (SELECT p FROM reach)),
final AS (SELECT a, t, b, ref FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), t, greatest(a, b) ORDER BY turn) AS r FROM edges) WHERE r = 1),
old AS (SELECT p_partkey // 2 AS a, 'implementation' AS t, p_partkey AS b FROM part WHERE p_partkey % 6 = 0 AND p_partkey > 0),
parent AS (SELECT s.id, l.id AS parent FROM el JOIN seen s USING (p) JOIN ids l ON l.p = el.q WHERE t = 'extension' AND el.q IN (SELECT p FROM reach)),
folded AS (SELECT *, p_name || CASE WHEN p % 5 = 0 THEN ' & Co' ELSE '' END AS name FROM seen)
SELECT 'item' AS kind, i.id AS a, coalesce(f.p + 100000, i.bgg_id) AS b, coalesce(f.name || '/' || replace(lower(f.name), '&', 'and'), i.canonical_name || '/' || i.normalized_name) AS name,
    coalesce(CASE WHEN f.id IS NULL THEN i.item_type WHEN f.p_size % 7 = 0 THEN 'expansion' ELSE 'base_game' END, '') || '/' || coalesce(CAST(CAST(round(f.p_size / 7, 2) AS DECIMAL(8, 2)) AS VARCHAR), '') || '/' || coalesce(CAST(parent AS VARCHAR), '') AS more
FROM (SELECT id, bgg_id, canonical_name, normalized_name, item_type FROM items UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM seen WHERE p NOT IN (SELECT p FROM own)) i LEFT JOIN folded f ON f.id = i.id LEFT JOIN parent ON parent.id = i.id
UNION ALL SELECT 'alias', id, NULL, 'Alt eé ' || p_name, 'alt ee ' || p_name FROM seen
UNION ALL SELECT kind, id, bgg, name, NULL FROM lookups
UNION ALL SELECT DISTINCT 'item ' || l.kind, l.item_id, k.id, NULL, NULL FROM links l JOIN lookups k USING (kind, bgg) WHERE kind <> 'person'
UNION ALL SELECT DISTINCT 'item person', item_id, k.id, NULL, role FROM (SELECT id AS item_id, p % 50 + 1 AS bgg, 'designer' AS role FROM seen UNION SELECT id, p % 30 + 1, 'artist' FROM seen) JOIN lookups k USING (bgg) WHERE kind = 'person'
UNION ALL SELECT 'house', k.id, coalesce(k.bgg, d.bgg), k.name, CASE WHEN k.id IN (SELECT id FROM house_of) THEN 'house ' || k.id - 1 ELSE 'old' END FROM known k LEFT JOIN adopted d USING (id)
UNION ALL SELECT DISTINCT 'item house', item_id, h.id, NULL, NULL FROM links l JOIN house_of h USING (bgg) WHERE l.kind = 'house'
UNION ALL SELECT 'edge', a, b, t, 'BGG/' || ref FROM final
UNION ALL SELECT 'edge', a, b, t, 'manual/' FROM old WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.t = old.t AND least(f.a, f.b) = least(old.a, old.b) AND greatest(f.a, f.b) = greatest(old.a, old.b))"""


@query(IMPORTED)
def item_import(spark, sf):
    """Every tenth record imported with all that it leads to: each table of the bundle, one below the other."""
    roots = tables.read(spark, sf, "part").where("p_partkey % 10 = 0").select((F.col("p_partkey") + 100000).alias("external_id"))
    got = importing.import_bundle(state(spark, sf), roots, records.things(record_documents(spark, sf)), F.lit(AS_OF).cast("timestamp"), fold_title)
    none = F.lit(None).cast("string")

    def rows(table, kind, a, b, name=none, more=none):
        return got[table].select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("long")).alias("b"), name.alias("name"), more.alias("more"))

    rating, parent = F.coalesce(F.when(F.col("year_published").isNotNull(), F.col("rating").cast("string")), F.lit("")), F.coalesce(F.col("parent_item_id").cast("string"), F.lit(""))
    parts = [
        rows("items", "item", "id", "bgg_id", F.concat("canonical_name", F.lit("/"), "normalized_name"), F.concat_ws("/", F.col("item_type"), rating, parent)),
        rows("aliases", "alias", "item_id", None, F.col("alias"), F.col("normalized_alias")), rows("lookups", F.col("kind"), "id", "bgg_id", F.col("name")), rows("contributors", "person", "id", "bgg_id", F.col("name")),
        rows("item_lookups", F.concat(F.lit("item "), "kind"), "item_id", "lookup_id"), rows("item_contributors", "item person", "item_id", "contributor_id", more=F.col("role")),
        rows("publishers", "house", "id", "bgg_id", F.col("name"), F.col("normalized_name")), rows("item_publishers", "item house", "item_id", "publisher_id"),
        rows("relationships", "edge", "item_a_id", "item_b_id", F.col("link_type"), F.concat("source", F.lit("/"), F.coalesce("source_ref", F.lit("")))),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


CREATED = SQL + """, one AS (SELECT id, min(store_id) AS store_id, min(source_url) AS source_url FROM store_items WHERE item_id IS NULL GROUP BY id),
l AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE store_id END AS store_id, CASE WHEN id % 7 = 0 THEN ' ' ELSE 'Game ' || id END AS title, CASE id % 4 WHEN 0 THEN ' House ' || id % 30 || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'New ' || id % 5 END AS publisher,
    CASE WHEN id % 3 = 0 THEN 'expansion' ELSE 'unknown' END AS item_type, CASE WHEN id % 2 = 0 THEN id % 50 END AS impl, CASE WHEN id % 5 = 0 THEN id % 40 END AS ext FROM one),
c AS (SELECT *, (SELECT max(id) FROM items) + row_number() OVER (ORDER BY id) AS item FROM l WHERE store_id IS NOT NULL AND trim(title) <> ''),
known AS (SELECT n_nationkey + 1 AS id, 'House ' || n_nationkey AS name FROM nation), named AS (SELECT trim(publisher) AS name, min(id) AS first FROM c WHERE trim(coalesce(publisher, '')) <> '' GROUP BY 1),
fresh AS (SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first) AS id, name FROM named WHERE name NOT IN (SELECT name FROM known)), houses AS (SELECT * FROM known UNION ALL SELECT * FROM fresh),
links AS (SELECT p_partkey AS item_id, 'category' AS t, p_type AS c FROM part UNION ALL SELECT p_partkey, 'family', p_brand FROM part)
SELECT 'item' AS kind, item AS a, ext AS b, title AS name, CASE WHEN item_type = 'expansion' THEN 'expansion' ELSE 'base_game' END || '/' || lower(title) AS more FROM c
UNION ALL SELECT 'listing', id, (SELECT item FROM c WHERE c.id = l.id), CASE WHEN id IN (SELECT id FROM c) THEN 'MANUAL' END, NULL FROM l
UNION ALL SELECT 'house', id, NULL, name, CASE WHEN name IN (SELECT name FROM named) THEN lower(name) ELSE 'old' END FROM houses
UNION ALL SELECT 'item house', c.item, h.id, NULL, NULL FROM c JOIN houses h ON h.name = trim(c.publisher)
UNION ALL SELECT 'edge', item, impl, 'implementation', 'admin/' || id FROM c WHERE impl IS NOT NULL UNION ALL SELECT 'edge', item, ext, 'extension', 'admin/' || id FROM c WHERE ext IS NOT NULL
UNION ALL SELECT DISTINCT 'link', item, NULL, t || ' ' || c, NULL FROM (SELECT item, impl AS p FROM c UNION SELECT item, ext FROM c) JOIN links ON links.item_id = p"""


@query(CREATED)
def created_items(spark, sf):
    """An item of each listing without one, with its publisher, edges and the taxonomy of what it implements and extends."""
    listed = tables.store_items(spark, sf).where("item_id is null").groupBy("id").agg(F.min("store_id").alias("store_id"), F.min("source_url").alias("source_url"))
    key, none = F.col("id"), lambda kind: F.lit(None).cast(kind)
    text = lambda prefix, c, end="": F.concat(F.lit(prefix), c.cast("string"), F.lit(end))
    listings = listed.select(
        "id", F.when(key % 11 != 0, F.col("store_id")).alias("store_id"), "source_url", F.when(key % 7 == 0, " ").otherwise(text("Game ", key)).alias("title"),
        F.when(key % 4 == 0, text(" House ", key % 30, " ")).when(key % 4 == 1, "").when(key % 4 == 3, text("New ", key % 5)).alias("publisher"), F.when(key % 3 == 0, "expansion").otherwise("unknown").alias("item_type"),
        none("bigint").alias("item_id"), none("string").alias("match_source"), none("timestamp").alias("last_updated"),
    )
    wanted = listed.select("id", F.when(key % 2 == 0, key % 50).alias("implements_id"), F.when(key % 5 == 0, key % 40).alias("extends_id"))
    before = state(spark, sf)
    part = tables.read(spark, sf, "part")
    links = part.select(F.col("p_partkey").alias("item_id"), F.lit("category").alias("category_type"), F.col("p_type").alias("category_id")).union(part.select("p_partkey", F.lit("family"), "p_brand"))
    held = {n: before[n] for n in ("items", "publishers", "item_publishers")} | {"listings": listings, "relationships": before["relationships"].limit(0), "links": links}
    got = importing.items_of_listings(held, wanted, F.lit(AS_OF).cast("timestamp"), fold_title)
    last, no, nothing = tables.items(spark, sf).agg(F.max("id").alias("last")), F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = lambda df, kind, a, b, name=no, more=no: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else nothing).alias("b"), name.alias("name"), more.alias("more"))
    fresh = lambda df, column: df.crossJoin(F.broadcast(last)).where(F.col(column) > F.col("last"))
    parts = [
        rows(fresh(got["items"], "id"), "item", "id", "parent_item_id", F.col("canonical_name"), F.concat("item_type", F.lit("/"), "normalized_name")), rows(got["listings"], "listing", "id", "item_id", F.col("match_source")),
        rows(got["publishers"], "house", "id", None, F.col("name"), F.col("normalized_name")), rows(got["item_publishers"], "item house", "item_id", "publisher_id"),
        rows(got["relationships"], "edge", "item_a_id", "item_b_id", F.col("link_type"), F.concat("source", F.lit("/"), "source_ref")),
        rows(fresh(got["links"], "item_id"), "link", "item_id", None, F.concat("category_type", F.lit(" "), "category_id")),
    ]
    whole = parts[0]
    for one in parts[1:]:
        whole = whole.unionByName(one)
    return whole
