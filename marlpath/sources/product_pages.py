"""Product pages read in steps: elements, then structured data, then the one product that a page is about, then its details."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offers import availability_of_page, field_number, item_type_of, language_of, min_age_of, minutes_of, players_of, price_of_page
from ..functions.text import collapse, without_accents, without_site_suffix
from .products import NESTING, fold_words, is_a, largest_source, likeness, listed, member, none_of, opened, place_of, text_of, visible_description

#: Classes of elements that hold menus, prices, stock notes, labelled facts and pictures, and elements without an end.
HIDDEN = ("elementor-menu-cart", "elementor-menu-cart__toggle", "elementor-menu-cart__toggle_button", "widget_shopping_cart_content")
GALLERY = ("elementor-widget-woocommerce-product-images", "woocommerce-product-gallery", "woocommerce-product-gallery__image")
PICTURE, PRICE, STOCK, FACT = "wp-post-image", "elementor-widget-woocommerce-product-price", "stock", "product__text"
ENDLESS = ("area", "base", "br", "circle", "col", "embed", "hr", "img", "input", "link", "meta", "param", "path", "rect", "source", "track", "wbr")
PICTURES = (".avif", ".gif", ".jpeg", ".jpg", ".png", ".webp")
#: Where the text after a language label ends, at the latest after so many characters.
SNIPPET_STOPS, SNIPPET = (" Añadir ", " Producto añadido", " Entrega ", " Productos Relacionados", " Related Products", " Menu ", " Menú ", " Contacto "), 220
MIN_AGE, PUBLISHER = ("edad minima",), ("editorial", "publisher")

READ = (
    "title string, h1 string, h2 string, meta map<string,string>, nodes array<string>, scripts array<string>, price_blocks array<string>, "
    "stock_blocks array<struct<class: string, text: string>>, facts array<string>, gallery array<string>, images array<struct<alt: string, sources: array<string>, srcset: string, own: boolean>>"
)


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Reader(HTMLParser):
    """Keeps the open elements, each with what it is for; texts go to the innermost block that wants them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, list[str], str]] = []
        self.texts: dict[str, list[str]] = {"title": [], "h1": [], "h2": []}
        self.meta: dict[str, str] = {}
        self.nodes, self.scripts, self.prices, self.facts, self.gallery = [], [], [], [], []
        self.stock: list[dict] = []
        self.images: list[dict] = []

    def inside(self, role: str) -> list[str] | None:
        return next((held for _, r, held, _ in reversed(self.open) if r == role), None)

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        names = own.get("class", "").lower().split()
        if self.inside("hidden") is None:
            if tag == "meta" and (key := own.get("property") or own.get("name")) and own.get("content", "").strip():
                self.meta[key.lower()] = own["content"].strip()
            if tag == "img":
                sources = [own.get(k, "").strip() for k in ("data-large_image", "data-src", "data-lazy-src", "src")]
                mine = self.inside("gallery") is not None or PICTURE in names or own.get("itemprop", "").lower() == "image"
                self.images.append({"alt": own.get("alt", "").strip(), "sources": [s for s in sources if s and not s.startswith("data:")], "srcset": own.get("srcset", ""), "own": mine})
            if tag == "a" and self.inside("gallery") is not None and own.get("href", "").split("?")[0].split("#")[0].lower().endswith(PICTURES):
                self.gallery.append(own["href"].strip())
        if tag in ENDLESS:
            return
        role = ""
        if tag in ("style", "noscript") or any(n in HIDDEN for n in names):
            role = "hidden"
        elif tag == "script":
            role = "json" if "ld+json" in own.get("type", "").lower() else "script"
        elif PRICE in names or (tag == "p" and "price" in names):
            role = "price"
        elif STOCK in names:
            role = "stock"
        elif FACT in names:
            role = "fact"
        elif any(n in GALLERY for n in names):
            role = "gallery"
        self.open.append((tag, role, [], " ".join(names)))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        while at is not None and len(self.open) > at:
            self.end(*self.open.pop()[1:])

    def end(self, role: str, held: list[str], names: str) -> None:
        text = "".join(held).strip() if role == "json" else squeezed(" ".join(held))
        if not text or self.inside("hidden") is not None:
            return
        if role == "stock":
            self.stock.append({"class": names, "text": text})
        elif role in ("json", "price", "fact"):
            {"json": self.scripts, "price": self.prices, "fact": self.facts}[role].append(text)

    def handle_data(self, data):
        for role in ("json", "script", "hidden", "price", "stock"):
            held = self.inside(role)
            if held is not None:
                held.append(data)
                return
        text = squeezed(data)
        if not text:
            return
        if (held := self.inside("fact")) is not None:
            held.append(text)
        self.nodes.append(text)
        heading = next((t for t, *_ in reversed(self.open) if t in ("title", "h1", "h2", "h3")), None)
        if heading in self.texts:
            self.texts[heading].append(text)

    def close(self):
        super().close()
        while self.open:
            self.end(*self.open.pop()[1:])


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and others) with the columns of READ in place of html: what a page's elements hold, in its order. Null pages are empty. The others stay where they are."""

    @F.pandas_udf(READ)
    def held(html: pd.Series) -> pd.DataFrame:
        rows = []
        for text in html:
            r = Reader()
            r.feed(text or "")
            r.close()
            heads = [" ".join(r.texts["title"]), " ".join(r.texts["h1"]), r.texts["h2"][0] if r.texts["h2"] else ""]
            rows.append((*heads, r.meta, r.nodes, r.scripts, r.prices, r.stock, r.facts, r.gallery, r.images))
        return pd.DataFrame(rows, columns=NAMES)

    # not to be done again for a condition on what it gives
    read = pages.withColumns({"url": F.coalesce("url", F.lit("")), "_held": held.asNondeterministic()("html")})
    return read.select(*[c for c in pages.columns if c != "html"], "_held.*")


NAMES = ("title", "h1", "h2", "meta", "nodes", "scripts", "price_blocks", "stock_blocks", "facts", "gallery", "images")


def record_of(product: Column, group: Column) -> Column:
    """struct(name, urls, price, stock, currency, sku, description, publisher, image) of a product; what its group says of all its variants goes before its own."""
    of_group = lambda name: F.nullif(text_of(group, name), F.lit(""))
    both = lambda name: F.coalesce(of_group(name), text_of(product, name))
    any_of = lambda name: F.coalesce(member(group, name, "variant"), member(product, name, "variant"))
    offers = F.filter(listed(any_of("offers")), lambda o: F.try_variant_get(o, "$", "map<string,variant>").isNotNull())
    urls = F.filter(F.concat(F.array(both("url"), both("@id")), F.transform(offers, lambda o: text_of(o, "url"))), lambda u: u != "")
    first = F.try_element_at(offers, F.lit(1))
    house = [F.coalesce(F.nullif(F.trim(member(any_of(k), "name", "string")), F.lit("")), F.nullif(both(k), F.lit(""))) for k in ("publisher", "brand", "manufacturer")]
    pictures = F.filter(F.transform(listed(any_of("image")), lambda i: F.coalesce(F.nullif(F.trim(member(i, "url", "string")), F.lit("")), F.nullif(plain_text(i), F.lit("")))), lambda u: u.isNotNull())
    return F.struct(
        both("name").alias("name"), urls.alias("urls"), text_of(first, "price").alias("price"), text_of(first, "availability").alias("stock"), text_of(first, "priceCurrency").alias("currency"),
        both("sku").alias("sku"), both("description").alias("description"), F.coalesce(*house, F.lit("")).alias("publisher"), F.coalesce(F.try_element_at(pictures, F.lit(1)), F.lit("")).alias("image"),
    )


def plain_text(node: Column) -> Column:
    value = F.trim(F.coalesce(F.try_variant_get(node, "$", "string"), F.lit("")))
    return F.when(value.rlike(r"^[\[{]"), "").otherwise(value)


def structured_products(scripts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with order and product for each product in the JSON texts (``scripts``) of a page.

    Lists are unpacked, and objects that aren't products give way to their main entity and graph: each turn, NESTING at most, is
    an explode that keeps the order. Numbers with a leading zero are read as texts; what isn't JSON gives none.
    """
    repaired = F.regexp_replace("s", r'("gtin\d*"\s*:\s*)(0\d+)', r'$1"$2"')
    found = scripts.select(*keys, F.posexplode("scripts").alias("p", "s"))
    found = found.select(*keys, F.array("p").alias("order"), F.coalesce(F.try_parse_json("s"), F.try_parse_json(repaired)).alias("node")).where("node is not null")
    for _ in range(NESTING):
        found = found.select(*keys, "order", F.posexplode(opened(F.array("node"))).alias("p", "node")).select(*keys, F.concat("order", F.array("p")).alias("order"), "node")
    node, alone = F.col("node"), F.lit(None).cast("variant")
    variants = F.transform(F.filter(listed(member(node, "hasVariant", "variant")), lambda v: is_a(v, "product")), lambda v: F.struct(v.alias("own"), node.alias("above")))
    made = F.when(is_a(node, "product"), F.array(F.struct(node.alias("own"), alone.alias("above")))).when(is_a(node, "productgroup"), variants)
    found = found.select(*keys, "order", F.posexplode(made).alias("p", "v")).select(*keys, F.concat("order", F.array("p")).alias("order"), record_of(F.col("v.own"), F.col("v.above")).alias("product"))
    return found


def picked_products(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """(page_id, product) of pages (page_id, url, titles, scripts): of its products one with the page's address, else the one most like its titles, else the first. Dealt by page_id over so many ``tasks``, if told."""
    keys = ["page_id", "url", "titles"]
    found = structured_products(pages.where(F.size("scripts") > 0), keys).withColumn("here", place_of(F.col("url"), F.col("url")))
    own = F.exists("product.urls", lambda u: place_of(u, F.col("url")) == F.col("here")) & (F.col("url") != "")
    found = found.select("page_id", "order", "product", own.alias("own"), likeness(F.col("product.name"), F.col("titles")).alias("like"))
    found = found if tasks is None else found.repartition(tasks, "page_id")
    return found.groupBy("page_id").agg(F.min_by("product", F.struct(~F.col("own"), -F.col("like"), F.col("order"))).alias("product"))


def product_pages(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """page_id, url, and the columns of READ for pages (page_id, url, html; one row an id), with heading, titles, text and product (null without structured data).

    Products are never broadcast, as Spark takes them to be far smaller than they are. They meet the pages before these are read
    for the result, so what the elements hold is not shuffled; nor are pages that are dealt by page_id over so many ``tasks``.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    heading = F.coalesce(F.nullif("h1", F.lit("")), "h2")
    og = F.coalesce(F.col("meta")["og:title"], F.lit(""))
    titles = F.array(heading, F.col("h1"), without_site_suffix(og), og, without_site_suffix(F.col("title")), F.col("title"))
    read = lambda df: read_pages(df).withColumns({"heading": heading, "titles": titles, "text": F.array_join("nodes", " ")})
    picked = picked_products(read(pages).select("page_id", "url", "titles", "scripts"), tasks)
    told = read(pages.join(picked.hint("merge"), "page_id", "left"))
    return told.select(*[c for c in told.columns if c != "product"], "product")


def labelled_facts(blocks: Column) -> Column:
    """A map of folded labels to values of texts such as "Jugadores: 2-4"; of a label said twice the last counts."""
    pairs = F.transform(F.filter(blocks, lambda b: b.contains(":")), lambda b: F.struct(fold_words(F.substring_index(b, ":", 1)).alias("k"), collapse(F.substring(b, F.instr(b, ":") + 1, F.length(b))).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]))


def fact(facts: Column, labels: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(facts, F.lit(label)), F.lit("")) for label in labels], F.lit(""))


def snippets(text: Column, label: str) -> Column:
    """The texts from each place of a label on: up to a stop or SNIPPET characters."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(?=(\b(?:{label})\s*:.{{0,{SNIPPET}}}))"), 1)
    stops = "|".join(SNIPPET_STOPS)
    return F.transform(found, lambda s: collapse(F.regexp_replace(F.left(s, F.lit(SNIPPET)), f"(?s)(?<=.)(?:{stops}).*$", "")))


def language_told(title: Column, url: Column, description: Column, text: Column) -> Column:
    """struct(language, source, evidence): by title, address, a highlights or language label, description or text, the first that names one language."""
    folded = lambda c: language_of(without_accents(c))
    plain = collapse(F.coalesce(text, F.lit("")))
    near = r"(?is)^.*?(.{0,80}(?:english|ingl[eé]s|spanish|espa[nñ]ol|castellano).{0,112})"
    around = lambda c: F.coalesce(F.nullif(F.regexp_extract(collapse(c), near, 1), F.lit("")), F.left(collapse(c), F.lit(200)))
    made = lambda source, language, evidence: F.when(language != "", F.struct(language.alias("language"), F.lit(source).alias("source"), evidence.alias("evidence")))

    def labelled(source, label):
        hit = F.try_element_at(F.filter(snippets(plain, label), lambda s: folded(s) != ""), F.lit(1))
        return made(source, F.coalesce(folded(hit), F.lit("")), hit)

    return F.coalesce(
        made("title", folded(title), collapse(title)), made("source_url", folded(url), collapse(url)), labelled("product_highlights", "highlights?"), labelled("product_language_label", "idioma|language"),
        made("description", folded(description), around(description)), made("page_text", folded(text), around(text)), F.struct(*[F.lit("").alias(n) for n in ("language", "source", "evidence")]),
    )


def picture_of(title: Column) -> Column:
    """A page's picture: structured data's, the gallery's, one whose text is like the title, else a shared one."""
    source = lambda i: F.coalesce(F.try_element_at(i["sources"], F.lit(1)), largest_source(i["srcset"]))
    own = F.filter(F.concat(F.col("gallery"), F.transform(F.filter("images", lambda i: i["own"]), source)), lambda u: u != "")
    name = fold_words(title)
    like = lambda i: (name != "") & (fold_words(i["alt"]) != "") & (fold_words(i["alt"]).contains(name) | name.contains(fold_words(i["alt"])))
    titled = F.filter("images", lambda i: (source(i) != "") & ~source(i).startswith("data:") & like(i))
    meta = [F.col("meta")[k] for k in ("og:image", "twitter:image", "twitter:image:src")]
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.col("product.image")), some(F.try_element_at(own, F.lit(1))), some(source(F.try_element_at(titled, F.lit(1)))), *[some(m) for m in meta], F.lit(""))


def details(read: DataFrame) -> DataFrame:
    """Listing details from product_pages, as columns; prices, stock and language with where they were found. Pages without a title have an empty one."""
    some = lambda c: F.nullif(collapse(F.coalesce(c, F.lit(""))), F.lit(""))
    og = F.coalesce(F.col("meta")["og:title"], F.lit(""))
    title = F.coalesce(some(F.col("product.name")), some(F.col("heading")), some(without_site_suffix(og)), some(og), some(without_site_suffix(F.col("title"))), F.lit(""))
    told = read.withColumns({"_title": title, "facts": labelled_facts(F.col("facts"))})
    told = told.withColumn("_description", F.coalesce(some(F.col("product.description")), some(visible_description(F.col("_title"), F.col("nodes"))), some(F.col("meta")["og:description"]), some(F.col("meta")["description"]), F.lit("")))
    text, of = F.col("text"), lambda name: F.coalesce(F.col(f"product.{name}"), F.lit(""))
    price, stock = price_of_page(of("price"), F.col("price_blocks"), text), availability_of_page(of("stock"), F.col("stock_blocks"), text)
    age = field_number(F.col("facts"), MIN_AGE)
    house = F.try_element_at(F.filter(F.transform("nodes", lambda n: F.trim(F.regexp_extract(n, r"(?i)(?:editorial|publisher)\s*:?\s*(.+)", 1))), lambda n: n != ""), F.lit(1))
    return told.select(
        "page_id", "url", F.col("_title").alias("title"), F.col("_description").alias("description"), price["price"].alias("price"), price["source"].alias("price_source"),
        F.upper(F.coalesce(some(of("currency")), F.lit("MXN"))).alias("currency"), picture_of(F.col("_title")).alias("image"), of("sku").alias("sku"),
        F.coalesce(some(of("publisher")), some(fact(F.col("facts"), PUBLISHER)), some(house), F.lit("")).alias("publisher"), item_type_of(F.col("_title"), F.col("url")).alias("item_type"),
        players_of(text, F.col("facts")).alias("players"), minutes_of(text, F.col("facts")).alias("minutes"), F.coalesce(F.when(age.between(1, 99), age), min_age_of(text)).alias("min_age"),
        language_told(F.col("_title"), F.col("url"), F.col("_description"), text).alias("language"), stock["availability"].alias("availability"), stock["source"].alias("availability_source"),
    )
