"""Text, address, price, availability, language and classification kernels over texts made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, offers, text
from ..sources import pages, product_pages, products, tables
from .binding import query

#: Offer texts of listings, in DuckDB's and in Spark's words.
OFFERS = """WITH o AS (SELECT l_orderkey * 8 + l_linenumber AS id, p_name, p_size, l_linenumber AS n,
    CASE l_linenumber % 4 WHEN 0 THEN 'Precio $ 1,' || p_size || '99 ' WHEN 1 THEN p_size || '.50 MXN ' WHEN 2 THEN 'mxn ' || p_partkey || ' ' ELSE 'sin precio ' END
    || CASE l_orderkey % 5 WHEN 0 THEN 'Agotado disponible' WHEN 1 THEN 'En Stock' WHEN 2 THEN 'Agregar al carrito' WHEN 3 THEN 'No disponible' ELSE 'pronto' END AS t
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def offer_texts(spark, sf):
    line = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    joined = line.join(tables.read(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    n, k = F.col("l_linenumber") % 4, F.col("l_orderkey") % 5
    price = (
        F.when(n == 0, F.concat(F.lit("Precio $ 1,"), "p_size", F.lit("99 "))).when(n == 1, F.concat("p_size", F.lit(".50 MXN ")))
        .when(n == 2, F.concat(F.lit("mxn "), "p_partkey", F.lit(" "))).otherwise("sin precio ")
    )
    stock = F.when(k == 0, "Agotado disponible").when(k == 1, "En Stock").when(k == 2, "Agregar al carrito").when(k == 3, "No disponible").otherwise("pronto")
    return joined.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "p_name", "p_size", F.col("l_linenumber").alias("n"), F.concat(price, stock).alias("t"))


@query(OFFERS + r""", r AS (SELECT id, t, regexp_extract(t, '(?i)(?:\$\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*mxn|mxn\s*([0-9][0-9,.]*))', 0) AS raw,
    replace(coalesce(nullif(regexp_extract(t, '(?i)(?:\$\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*mxn|mxn\s*([0-9][0-9,.]*))', 1), ''), nullif(regexp_extract(t, '(?i)(?:\$\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*mxn|mxn\s*([0-9][0-9,.]*))', 2), ''),
    regexp_extract(t, '(?i)(?:\$\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*mxn|mxn\s*([0-9][0-9,.]*))', 3)), ',', '') AS v FROM o)
SELECT id, trim(raw) AS raw_price, CASE WHEN v = '' OR v LIKE '%.%' THEN v ELSE v || '.00' END AS price FROM r""")
def price_extract(spark, sf):
    found = offer_texts(spark, sf).select("id", offers.price_of(F.col("t")).alias("p"))
    return found.select("id", F.col("p.raw").alias("raw_price"), F.col("p.price").alias("price"))


@query(OFFERS + """ SELECT id, CASE WHEN regexp_matches(lower(t), 'agotado|sin stock|no disponible') THEN 'out_of_stock'
    WHEN regexp_matches(lower(t), 'disponible|en stock|agregar al carrito|comprar') THEN 'available' ELSE 'unknown' END AS availability FROM o""")
def availability_classify(spark, sf):
    return offer_texts(spark, sf).select("id", offers.availability_of(F.col("t")).alias("availability"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '^www\.', ''), '^m\.', ''), '^amp\.', '') AS domain,
    regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS homepage, regexp_replace(url, '[;?#].*$', '') AS clean FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages)""")
def domain_canonical(spark, sf):
    url = F.col("url")
    return tables.read(spark, sf, "pages").select("page_id", offers.canonical_domain(url).alias("domain"), offers.homepage(url).alias("homepage"), offers.clean_url(url).alias("clean"))


@query(r"""SELECT regexp_replace(regexp_replace(h, '^www\.', ''), '^m\.', '') AS domain, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages) GROUP BY 1""")
def domain_buckets(spark, sf):
    seen = tables.read(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))
    return pages.domain_buckets(seen, offers.canonical_domain(F.col("url"))).select("domain", "n")


@query(OFFERS + """, l AS (SELECT id, p_name || CASE WHEN p_size % 4 = 0 THEN ' English' WHEN p_size % 4 = 1 THEN ' Espanol' WHEN p_size % 4 = 2 THEN ' English Spanish' ELSE '' END AS title,
    CASE n % 3 WHEN 0 THEN 'idioma castellano' WHEN 1 THEN 'in english' ELSE '' END AS body FROM o),
f AS (SELECT id, [regexp_matches(lower(title), '\\b(english|ingles)\\b'), regexp_matches(lower(title), '\\b(spanish|espanol|castellano)\\b'), regexp_matches(body, '\\b(english|ingles)\\b'), regexp_matches(body, '\\b(spanish|espanol|castellano)\\b')] AS m FROM l)
SELECT id, CASE WHEN m[1] AND NOT m[2] THEN 'en' WHEN m[2] AND NOT m[1] THEN 'es' WHEN m[3] AND NOT m[4] THEN 'en' WHEN m[4] AND NOT m[3] THEN 'es' ELSE '' END AS language,
    CASE WHEN m[1] <> m[2] THEN 'title' WHEN m[3] <> m[4] THEN 'description' ELSE '' END AS source FROM f""".replace("\\\\b", "\\b"))
def language_cascade(spark, sf):
    size, n = F.col("p_size") % 4, F.col("n") % 3
    title = F.concat("p_name", F.when(size == 0, " English").when(size == 1, " Espanol").when(size == 2, " English Spanish").otherwise(""))
    body = F.when(n == 0, "idioma castellano").when(n == 1, "in english").otherwise("")
    found = offer_texts(spark, sf).select("id", offers.language_cascade(title=title, description=body).alias("l"))
    return found.select("id", "l.language", "l.source")


@query("""SELECT page_id, CASE WHEN contains(t, ' | ') THEN trim(split_part(t, ' | ', 1)) ELSE trim(split_part(t, ' - ', 1)) END AS title
FROM (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/', 1) || CASE page_id % 3 WHEN 0 THEN ' | Tienda - MX' WHEN 1 THEN ' - Tienda' ELSE '' END AS t FROM pages)""")
def title_suffix_strip(spark, sf):
    rest = F.when(F.col("page_id") % 3 == 0, " | Tienda - MX").when(F.col("page_id") % 3 == 1, " - Tienda").otherwise("")
    title = F.concat(F.split_part(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.lit("/"), F.lit(1)), rest)
    return tables.read(spark, sf, "pages").select("page_id", text.without_site_suffix(title).alias("title"))


def _terms(column: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"contains({column}, '{t}')::INT" for t in terms)


STORE_TEXT = """WITH d AS (SELECT s_suppkey AS id, lower(replace(n_name, ' ', '-')) || CASE WHEN s_suppkey % 2 = 0 THEN '.com.mx' ELSE '.com' END AS domain,
    CASE s_suppkey % 5 WHEN 0 THEN 'juegos de mesa catan carrito comprar mexico' WHEN 1 THEN 'board game shop checkout' WHEN 2 THEN 'meeple producto' WHEN 3 THEN 'zapatos precio cdmx' ELSE s_name END AS t
    FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT *, """


@query(STORE_TEXT + f"""{_terms('t', classify.GAME_TERMS)} AS g, {_terms('t', classify.SHOP_TERMS)} AS s, {_terms('t', classify.PLACE_TERMS)} AS m, domain LIKE '%.mx' AS mx FROM d),
c AS (SELECT *, g > 0 AND s > 0 AND (m > 0 OR mx) AS accepted, least(34 * (g > 0)::INT + 31 * (s > 0)::INT + 22 * (m > 0)::INT + 10 * mx::INT + 2 * (g > 1)::INT + (s > 1)::INT, 100) / 100.0 AS p FROM k)
SELECT id, accepted, CASE WHEN accepted THEN p ELSE least(p, 0.49) END::DOUBLE AS confidence,
    CASE WHEN g > 0 THEN '' ELSE 'missing_' END || 'boardgame,' || CASE WHEN s > 0 THEN '' ELSE 'missing_' END || 'online_store,' || CASE WHEN m > 0 OR mx THEN '' ELSE 'missing_' END || 'mexico' AS reasons FROM c""")
def term_score_classify(spark, sf):
    joined = tables.read(spark, sf, "supplier").join(tables.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 5
    words = F.when(k == 0, "juegos de mesa catan carrito comprar mexico").when(k == 1, "board game shop checkout").when(k == 2, "meeple producto").when(k == 3, "zapatos precio cdmx").otherwise(F.col("s_name"))
    domain = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.when(F.col("s_suppkey") % 2 == 0, ".com.mx").otherwise(".com"))
    found = joined.select(F.col("s_suppkey").alias("id"), classify.store_decision(domain, words).alias("d"))
    return found.select("id", "d.accepted", "d.confidence", F.array_join("d.reasons", ",").alias("reasons"))


@query("""WITH d AS (SELECT p_partkey AS id, p_size, CASE p_size % 6 WHEN 0 THEN 'juego de mesa familiar estrategia' WHEN 1 THEN 'catan expansion' WHEN 2 THEN 'paint brush set' WHEN 3 THEN 'party game' WHEN 4 THEN 'familiares paints' ELSE p_name END AS t,
    CASE WHEN p_size % 4 = 0 THEN 'devir mexico' ELSE '' END AS pub FROM part),
k AS (SELECT id, CASE p_size % 6 WHEN 0 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS n, p_size % 6 = 1 AS e, CASE p_size % 6 WHEN 2 THEN 2 ELSE 0 END AS m, (p_size % 3 = 0)::INT AS players, (p_size % 5 = 0)::INT AS age, (pub <> '')::INT AS known FROM d),
p AS (SELECT *, 0.35 * players + 0.15 * age + least(0.45, 0.15 * n) + 0.3 * known AS pos, least(0.85, 0.25 * m) AS neg FROM k)
SELECT id, CASE WHEN e THEN 'LIKELY_EXPANSION' WHEN pos >= 0.5 THEN 'LIKELY_BOARDGAME' WHEN neg >= 0.5 THEN 'LIKELY_NON_BOARDGAME' WHEN pos > 0 THEN 'LIKELY_BOARDGAME' ELSE 'UNCERTAIN' END AS category,
    round_even(CASE WHEN e THEN least(0.99, 0.75 + (pos + 0.3) / 4) WHEN pos >= 0.5 THEN least(0.99, 0.65 + pos / 3) WHEN neg >= 0.5 THEN least(0.99, 0.65 + neg / 3) WHEN pos > 0 THEN 0.55 + pos / 4 ELSE 0.5 END::DOUBLE, 2) AS p FROM p""")
def item_classify(spark, sf):
    k = F.col("p_size") % 6
    words = (
        F.when(k == 0, "juego de mesa familiar estrategia").when(k == 1, "catan expansion").when(k == 2, "paint brush set")
        .when(k == 3, "party game").when(k == 4, "familiares paints").otherwise(F.col("p_name"))
    )
    publisher = F.when(F.col("p_size") % 4 == 0, "devir mexico").otherwise("")
    made = tables.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        classify.item_decision(words, publisher, F.col("p_size") % 3 == 0, F.lit(False), F.col("p_size") % 5 == 0).alias("d"),
    )
    return made.select("id", "d.category", F.col("d.confidence").alias("p"))


def _words_sql(*cases: tuple[str, tuple[str, ...]]) -> str:
    return " || ".join(f"CASE WHEN {c} THEN {list(w)!r}::VARCHAR[] ELSE []::VARCHAR[] END" for c, w in cases)


@query(f"""WITH s AS (SELECT p_partkey AS id, p_name, p_brand, p_type, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 4 + 1 END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 10 + 1 END AS hi, p_size * 3 AS mins, (p_size % 10) / 2.0 AS cx, p_size % 18 AS age FROM part),
b AS (SELECT *, coalesce(lo, hi) AS l, coalesce(hi, lo) AS h FROM s),
w AS (SELECT *, {_words_sql(('l <= 1', classify.SOLO), ('l = 2 AND h = 2', classify.DUEL), ('h >= 5', classify.GROUP), ('h >= 8', classify.PARTY), ('mins < 45', classify.SHORT),
    ('mins >= 45 AND mins <= 90', classify.MEDIUM), ('mins > 90', classify.LONG), ('cx < 2', classify.LIGHT), ('cx >= 2 AND cx <= 3.5', classify.MIDDLE), ('cx > 3.5', classify.HEAVY),
    ('age <= 8', classify.KIDS), ('age > 8 AND age <= 10', classify.FAMILY), ('age > 10 AND age <= 13', classify.TEENS), ('age > 13', classify.ADULTS))} AS k FROM b),
u AS (SELECT *, list_transform(list_filter(list_zip(k, range(len(k))), lambda z: list_position(k, z[1]) = z[2] + 1), lambda z: z[1]) AS d FROM w),
t AS (SELECT id, 'Name: ' || p_name || chr(10) || 'Families: ' || p_brand || ', ' || p_type || CASE WHEN len(d) > 0 THEN chr(10) || 'Derived keywords: ' || array_to_string(d, ', ') ELSE '' END AS source_text FROM u)
SELECT id, source_text, sha256(source_text) AS source_hash FROM t""")
def embedding_text(spark, sf):
    size = F.col("p_size")
    low, high = F.when(size % 5 != 0, size % 4 + 1), F.when(size % 7 != 0, size % 10 + 1)
    words = classify.derived_keywords(low, high, size * 3, F.lit(None).cast("int"), (size % 10) / 2.0, size % 18)
    made = classify.labelled_lines({"Name": F.col("p_name"), "Families": F.concat_ws(", ", "p_brand", "p_type")}, words)
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), made.alias("source_text")).withColumn("source_hash", F.sha2("source_text", 256))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(lower(replace(p_name || ' & ' || p_type, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS title_key, lower(p_name) || '-x' AS store_key FROM part""")
def title_normalise(spark, sf):
    title = F.concat("p_name", F.lit(" & "), "p_type")
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.fold_title(title).alias("title_key"), text.fold_store(F.concat("p_name", F.lit("-X"))).alias("store_key"))


@query(OFFERS + r""", u AS (SELECT id, 'https://tienda.example.com/' || CASE n % 3 WHEN 0 THEN 'producto/' WHEN 1 THEN 'blog/' ELSE 'juegos//' END || replace(p_name, ' ', '-') || '_' || p_size || '/?ref=' || n AS url FROM o)
SELECT id, regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+([^?]*)', 1), '/(product|products|producto|productos|juego|juegos)/+[^/]') AS is_product,
    trim(regexp_replace(regexp_extract(regexp_replace(url, '/?\?.*$', ''), '([^/]*)$', 1), '-+', ' ', 'g')) AS slug FROM u""")
def url_parts(spark, sf):
    n = F.col("n") % 3
    url = F.concat(F.lit("https://tienda.example.com/"), F.when(n == 0, "producto/").when(n == 1, "blog/").otherwise("juegos//"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), "p_size", F.lit("/?ref="), "n")
    return offer_texts(spark, sf).select("id", offers.is_product_url(url).alias("is_product"), text.slug_title(url).alias("slug"))


@query(OFFERS + r""", k AS (SELECT id, p_size, n FROM o) SELECT id, (n + 1)::INT AS min_players, (n + 3)::INT AS max_players, p_size::INT AS min_minutes, p_size::INT AS max_minutes,
    CASE WHEN p_size BETWEEN 1 AND 99 THEN p_size END::INT AS min_age FROM k""")
def detail_numbers(spark, sf):
    body = F.concat(F.lit("De "), F.col("n") + 1, F.lit(" a "), F.col("n") + 3, F.lit(" jugadores, "), "p_size", F.lit(" minutos, Edad: "), "p_size", F.lit("+"))
    found = offer_texts(spark, sf).select("id", offers.players_of(body).alias("p"), offers.minutes_of(body).alias("m"), offers.min_age_of(body).alias("min_age"))
    return found.select("id", F.col("p.min").alias("min_players"), F.col("p.max").alias("max_players"), F.col("m.min").alias("min_minutes"), F.col("m.max").alias("max_minutes"), "min_age")


@query("""SELECT user_id, sum(CASE event_id % 3 WHEN 0 THEN event_id % 1000 ELSE (event_id % 90) * CASE event_id % 3 WHEN 1 THEN 1000 ELSE 1000000 END END)::BIGINT AS likes FROM events GROUP BY 1""")
def like_counts(spark, sf):
    k = F.col("event_id")
    shown = F.when(k % 3 == 0, (k % 1000).cast("string")).when(k % 3 == 1, F.concat(k % 90, F.lit("K"))).otherwise(F.concat(k % 90, F.lit(".0M")))
    return tables.read(spark, sf, "events").groupBy("user_id").agg(F.sum(offers.likes_of(shown)).alias("likes"))


@query()
def page_link_rows(spark, sf):
    """Every link of every page with the text around it; tested against hand-made pages."""
    return pages.page_links(tables.read(spark, sf, "pages"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '\s[|–—-]\s.*$', '')) AS site_title FROM pages""")
def site_titles(spark, sf):
    return tables.read(spark, sf, "pages").select("page_id", pages.site_title(F.col("html")).alias("site_title"))


@query()
def product_detail_rows(spark, sf):
    """The details of every page as a product page; tested against hand-made pages, and told_details has SQL for made ones."""
    found = product_pages.details(product_pages.product_pages(tables.read(spark, sf, "pages")))
    return found.select("page_id", "title", "description", "price", "availability", "min_age", F.col("language.language").alias("language"))


def told_pages(spark, sf):
    """A product page of each part: structured data on some, as a group's variant, a graph's product or a second script, else blocks, labelled facts and texts."""
    part, key, size = tables.spread(tables.read(spark, sf, "part"), "p_partkey"), F.col("p_partkey"), F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    url = text("https://www.shop.mx/products/p-", key, F.when(key % 3 == 0, "/?x=1").otherwise(""))
    product = text('{"@type": ["Thing", "Product"], "name": "', F.col("p_name"), '", "url": "/products/p-', key, '", "sku": ', size, ', "gtin13": 0123, "brand": {"name": "', F.col("p_brand"), '"}, "image": [{"url": "/i/', key, '.jpg"}], "offers": [1, {"price": "1,', size + 100, '.50", "priceCurrency": "usd", "availability": "https://schema.org/InStock"}]}')
    other = '{"@graph": [{"@type": "WebPage"}, [{"@type": "Product", "name": "Other thing", "url": "/products/other"}]]}'
    group = text('[{"@type": "WebPage", "mainEntity": {"@type": "ProductGroup", "name": "Group ', size, '", "hasVariant": [{"@type": "Product", "url": "/q"}, {"@type": "Product", "url": "/products/p-', key, '", "sku": "v', key, '"}]}}]')
    script = lambda json: text('<script type="application/ld+json">', json, "</script>")
    data = F.when(key % 4 == 0, F.concat(script(F.lit(other)), script(product))).when(key % 4 == 1, F.concat(script(F.lit(other)), script(group))).when(key % 4 == 2, script(F.lit("{bad"))).otherwise("")
    head = text("<html><head><title>", F.col("p_name"), ' | Tienda</title><meta content="/og.png" property="og:image"/>', data, "<style>p {color: red}</style></head><body>")
    menu = '<div class="elementor-menu-cart"><p class="price">$ 1.00</p><br>Carrito</div>'
    heading = F.when(key % 5 == 0, text("<h2>Sub</h2>")).otherwise(text("<h1>", F.col("p_name"), "</h1>"))
    blocks = text('<p class="price"><span>$ ', size, '.00</span></p><div class="x stock ', F.when(size % 2 == 0, "out-of-stock").otherwise("in-stock"), '">nota</div>')
    facts = text('<p class="product__text">N min jugadores: ', size % 4 + 1, '</p><p class="product__text">N&deg; max jugadores: 6</p><p class="product__text">Edad m&iacute;nima: ', size, '</p><p class="product__text">Editorial: Casa ', size % 3, "</p>")
    words = F.when(key % 7 == 0, "<p>Idioma: Español Menu English</p>").when(key % 7 == 1, "<p>English, español</p>").otherwise("")
    body = text(menu, heading, blocks, "<p>Un juego de prueba.</p>", facts, '<img alt="foto ', F.col("p_name"), '" src="data:x" data-src="/f/', key, '.png">', words, "<p>Copyright</p></body></html>")
    return part.select(key.alias("page_id"), url.alias("url"), F.concat(head, body).alias("html"))


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 1 THEN 'Group ' || p_size WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN 'Sub' ELSE p_name END AS title,
    CASE WHEN p_partkey % 4 = 0 THEN (1100 + p_size) || '.50' ELSE p_size || '.00' END AS price, CASE WHEN p_partkey % 4 = 0 THEN 'json_ld_offer' ELSE 'woocommerce_product_price' END AS price_source,
    CASE WHEN p_partkey % 4 = 0 THEN 'USD' ELSE 'MXN' END AS currency, CASE WHEN p_partkey % 4 = 0 OR p_size % 2 = 1 THEN 'available' ELSE 'out_of_stock' END AS availability,
    CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'v' || p_partkey ELSE '' END AS sku, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'Casa ' || p_size % 3 END AS publisher,
    CASE WHEN p_partkey % 4 = 0 THEN '/i/' || p_partkey || '.jpg' WHEN p_partkey % 4 = 1 OR p_partkey % 5 = 0 THEN '/og.png' ELSE '/f/' || p_partkey || '.png' END AS image,
    p_size % 4 + 1 AS least, 6 AS most, p_size AS age, CASE p_partkey % 7 WHEN 0 THEN 'es' ELSE '' END AS language, CASE p_partkey % 7 WHEN 0 THEN 'product_language_label' ELSE '' END AS told_by,
    CASE p_partkey % 7 WHEN 0 THEN 'Idioma: Español' ELSE '' END AS evidence FROM part""")
def told_details(spark, sf):
    found = product_pages.details(product_pages.product_pages(told_pages(spark, sf), tables.tasks(tables.read(spark, sf, "part"))))
    return found.select(
        "page_id", "title", "price", "price_source", "currency", "availability", "sku", "publisher", "image", F.col("players.min").alias("least"), F.col("players.max").alias("most"),
        F.col("min_age").alias("age"), "language.language", F.col("language.source").alias("told_by"), "language.evidence",
    )


@query(r"""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'tienda en nuevo leon' WHEN 1 THEN 'leon, nuevo leon' WHEN 2 THEN 'sucursal merida' WHEN 3 THEN 'baja california sur' WHEN 4 THEN 'cdmx' ELSE lower(c_mktsegment) END AS x FROM customer)
SELECT id, CASE id % 6 WHEN 1 THEN 'León' WHEN 2 THEN 'Mérida' WHEN 4 THEN 'Ciudad de México' ELSE '' END AS city,
    CASE id % 6 WHEN 0 THEN 'Nuevo León' WHEN 1 THEN 'Guanajuato' WHEN 2 THEN 'Yucatán' WHEN 3 THEN 'Baja California' WHEN 4 THEN 'Ciudad de México' ELSE '' END AS state FROM t""")
def store_locations(spark, sf):
    k = F.col("c_custkey") % 6
    words = F.when(k == 0, "tienda en nuevo leon").when(k == 1, "leon, nuevo leon").when(k == 2, "sucursal merida").when(k == 3, "baja california sur").when(k == 4, "cdmx").otherwise(F.lower("c_mktsegment"))
    return tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), products.location_of(words).alias("l")).select("id", "l.city", "l.state")


@query("""SELECT l_suppkey AS store_id, min_by(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_shipdate::DATE::VARCHAR END, (l_orderkey, l_linenumber)) FILTER (l_linenumber % 2 <> 0) AS first_date FROM lineitem GROUP BY 1""")
def metadata_merge(spark, sf):
    line = tables.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("store_id"), F.struct("l_orderkey", "l_linenumber").alias("pos"),
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_shipdate").cast("date").cast("string")).otherwise("").alias("first_date"),
    )
    return products.merged_metadata(line, "store_id", "pos", ["first_date"])
