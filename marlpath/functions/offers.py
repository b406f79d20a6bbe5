"""Addresses, prices, availability, players, minutes, ages and languages out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains that never are a store of their own.
BLOCKED_DOMAINS = (
    "amazon.com", "amazon.com.mx", "boardgamegeek.com", "ebay.com", "eventbrite.com", "facebook.com", "foursquare.com", "google.com",
    "instagram.com", "liverpool.com.mx", "maps.google.com", "mercadolibre.com", "mercadolibre.com.mx", "meetup.com", "pinterest.com",
    "reddit.com", "sanborns.com.mx", "sears.com.mx", "temu.com", "tiktok.com", "tripadvisor.com", "twitter.com", "walmart.com.mx",
    "wikipedia.org", "x.com", "youtube.com",
)
#: Path parts that a product's page has before its name.
PRODUCT_MARKERS = ("product", "products", "producto", "productos", "juego", "juegos")
#: Words of availability; the first list is tested first.
OUT_OF_STOCK = ("agotado", "sin stock", "no disponible")
IN_STOCK = ("disponible", "en stock", "agregar al carrito", "comprar")
#: What Spanish product texts say of players, minutes and ages: a range of players before or after the word,
#: the same only after it, a range of minutes, single minutes, an age behind its label, an age before "años".
PLAYERS = r"(?iu)(?:jugadores?\s*:?\s*)?(?:de\s+)?(\d+)\s*(?:-|–|a)\s*(\d+)\s*jugadores?"
PLAYERS_AFTER = r"(?iu)jugadores?\s*:?\s*(\d+)\s*(?:-|–|a)\s*(\d+)"
MINUTES = r"(?iu)(\d+)\s*(?:-|–|a)\s*(\d+)\s*min"
MINUTES_ONE = r"(?iu)(\d+)\s*min"
AGE = r"(?iu)\bedad(?:\s+m[ií]nima)?(?:\s+recomendada)?\s*:?\s*(\d{1,2})(?!\d)\s*\+?"
AGE_YEARS = r"(?iu)\b(\d{1,2})(?!\d)(?:\s*(?:-|–|a)\s*\d{1,2}(?!\d))?\s*\+?\s*(?:años|anos)\b"
#: Folded labels of product fields with players and minutes, in the order they are looked up.
LEAST_PLAYERS = ("n min jugadores", "no min jugadores", "numero min jugadores", "min jugadores", "jugadores minimos")
MOST_PLAYERS = ("n max jugadores", "no max jugadores", "numero max jugadores", "max jugadores", "jugadores maximos")
LEAST_MINUTES = ("tiempo min partida min", "tiempo minimo partida min", "duracion min", "minutos min")
MOST_MINUTES = ("tiempo max partida min", "tiempo maximo partida min", "duracion max", "minutos max")
#: Class names of stock blocks.
SOLD_OUT_CLASSES, STOCKED_CLASSES = ("out-of-stock", "outofstock"), ("in-stock", "instock")
#: Marker texts of store platforms in pages, headers and addresses, in the order they are tested.
PLATFORM_MARKERS = (
    ("shopify", ("cdn.shopify.com", "shopify.theme", "window.shopify", "myshopify.com", "x-shopify")),
    ("woocommerce", ("wp-content/plugins/woocommerce", "woocommerce-layout.css", "wc-ajax=", "wp-json/wc/")),
    ("godaddy_website_builder", ("dps_site_id", "websites + marketing", "godaddy website builder", 'server":"dps/')),
    ("wix", ("wixstatic.com", "x-wix-request-id", "wix-code-sdk")),
    ("squarespace", ("static1.squarespace.com", "squarespace.com/universal", "squarespace-context")),
    ("tiendanube", ("tiendanube.com", "nuvemshop.com.br", "storefront.nuvemshop")),
    ("prestashop", ("prestashop", "modules/ps_")),
    ("magento", ("mage/cookies", "magento_", "x-magento")),
    ("bigcommerce", ("cdn11.bigcommerce.com", "stencil-utils", "x-bc-")),
)
#: First path parts of social sites that are no account.
NO_ACCOUNT = {"instagram": ("accounts", "explore", "p", "reel", "stories"), "facebook": ("events", "plugins", "share", "sharer")}


def host(url: Column) -> Column:
    """The host of an address with or without a scheme, lower case, without port, user and outer dots."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^//", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(name), r"^\.+|\.+$", "")


def canonical_domain(url: Column) -> Column:
    """The host without "www.", then "m.", then "amp.", each once and in this order."""
    name = host(url)
    for prefix in ("www", "m", "amp"):
        name = F.regexp_replace(name, rf"^{prefix}\.", "")
    return name


def is_blocked(domain: Column) -> Column:
    listed = "|".join(d.replace(".", r"\.") for d in BLOCKED_DOMAINS)
    return domain.rlike(rf"^(.*\.)?({listed})$")


def homepage(url: Column) -> Column:
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(found != "", F.concat(found, F.lit("/"))).otherwise(url)


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[;?#].*$", "")


def is_product_url(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    return path.rlike(rf"/({'|'.join(PRODUCT_MARKERS)})/+[^/]")


def price_of(text: Column) -> Column:
    """(raw, price): the first of "$ n", "n mxn" and "mxn n"; commas go, and ".00" comes if there is no point."""
    pattern = r"(?i)(?:\$\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*mxn|mxn\s*([0-9][0-9,.]*))"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    value = F.replace(F.coalesce(part(1), part(2), part(3)), F.lit(","), F.lit(""))
    full = F.when(value.contains("."), value).otherwise(F.concat(value, F.lit(".00")))
    return F.struct(F.coalesce(F.trim(part(0)), F.lit("")).alias("raw"), F.coalesce(full, F.lit("")).alias("price"))


def first_price(**sources: Column) -> Column:
    """(source, price) of the first source with a price, in the order given."""
    cases = [F.when(c != "", F.struct(F.lit(n).alias("source"), c.alias("price"))) for n, c in sources.items()]
    return F.coalesce(*cases, F.struct(F.lit("").alias("source"), F.lit("").alias("price")))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def availability_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_word(low, OUT_OF_STOCK), "out_of_stock").when(any_word(low, IN_STOCK), "available").otherwise("unknown")


def availability_of_schema(value: Column) -> Column:
    low = F.lower(value)
    return F.when(any_word(low, ("instock", "in_stock")), "available").when(any_word(low, ("outofstock", "soldout", "out_of_stock")), "out_of_stock").otherwise("unknown")


def price_of_page(offer: Column, blocks: Column, text: Column) -> Column:
    """(source, price) of a page: its structured offer's, else that of the first price block with one, else that of its text."""
    amount = F.regexp_extract(F.replace(F.coalesce(offer, F.lit("")), F.lit(","), F.lit("")), r"^\s*(\d+(?:\.\d+)?)\s*$", 1)
    given = F.when(amount == "", "").when(amount.contains("."), amount).otherwise(F.concat(amount, F.lit(".00")))
    found = F.try_element_at(F.filter(F.transform(blocks, lambda b: price_of(b)["price"]), lambda p: p != ""), F.lit(1))
    chosen = first_price(json_ld_offer=given, woocommerce_product_price=F.coalesce(found, F.lit("")), generic_text=price_of(text)["price"])
    return F.struct(F.coalesce(F.nullif(chosen["source"], F.lit("")), F.lit("none")).alias("source"), chosen["price"].alias("price"))


def availability_of_page(offer: Column, blocks: Column, text: Column) -> Column:
    """(source, availability) of a page: its structured offer's, else by class or words of the first stock block (class, text) that tells, else by its text."""
    def told(block):
        names = F.split(F.lower(F.trim(block["class"])), r"\s+")
        has = lambda words: F.arrays_overlap(names, F.array(*[F.lit(w) for w in words]))
        return F.when(has(SOLD_OUT_CLASSES), "out_of_stock").when(has(STOCKED_CLASSES), "available").otherwise(availability_of(block["text"]))

    of_offer = availability_of_schema(F.coalesce(offer, F.lit("")))
    of_block = F.coalesce(F.try_element_at(F.filter(F.transform(blocks, told), lambda a: a != "unknown"), F.lit(1)), F.lit("unknown"))
    pair = lambda source, value: F.struct(F.lit(source).alias("source"), value.alias("availability"))
    of_text = availability_of(text)
    return (
        F.when(of_offer != "unknown", pair("json_ld_offer", of_offer)).when(of_block != "unknown", pair("woocommerce_stock", of_block))
        .when(of_text != "unknown", pair("generic_text", of_text)).otherwise(pair("none", F.lit("unknown")))
    )


def group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("int")


def field_number(fields: Column | None, labels: tuple[str, ...]) -> Column:
    """The first number in the field with the first of these (folded) labels; null without one."""
    if fields is None:
        return F.lit(None).cast("int")
    return group(F.coalesce(*[F.try_element_at(fields, F.lit(label)) for label in labels], F.lit("")), r"(\d+)", 1)


def players_of(text: Column, fields: Column | None = None) -> Column:
    """(min, max) players of "2 a 4 jugadores", "jugadores: 2-4" and the like; without such a text out of labelled fields (a map of folded labels)."""
    said = text.rlike(PLAYERS) | text.rlike(PLAYERS_AFTER)
    part = lambda i, labels: F.when(said, F.coalesce(group(text, PLAYERS, i), group(text, PLAYERS_AFTER, i))).otherwise(field_number(fields, labels))
    return F.struct(part(1, LEAST_PLAYERS).alias("min"), part(2, MOST_PLAYERS).alias("max"))


def minutes_of(text: Column, fields: Column | None = None) -> Column:
    """(min, max) minutes of a range, or of a single number both; without either out of labelled fields."""
    part = lambda i, labels: F.when(text.rlike(MINUTES), group(text, MINUTES, i)).when(text.rlike(MINUTES_ONE), group(text, MINUTES_ONE, 1)).otherwise(field_number(fields, labels))
    return F.struct(part(1, LEAST_MINUTES).alias("min"), part(2, MOST_MINUTES).alias("max"))


def min_age_of(text: Column) -> Column:
    """The age after a label, or before "años"; null unless from 1 to 99."""
    age = F.when(text.rlike(AGE), group(text, AGE, 1)).otherwise(group(text, AGE_YEARS, 1))
    return F.when(age.between(1, 99), age)


def language_of(text: Column) -> Column:
    """"en" or "es" if the (folded) text names one of them and not the other."""
    en, es = text.rlike(r"(?i)\b(english|ingles)\b"), text.rlike(r"(?i)\b(spanish|espanol|castellano)\b")
    return F.when(en & ~es, "en").when(es & ~en, "es").otherwise("")


def language_cascade(**sources: Column) -> Column:
    """(language, source) of the first source that names one language, in the order given."""
    cases = [F.when(language_of(c) != "", F.struct(language_of(c).alias("language"), F.lit(n).alias("source"))) for n, c in sources.items()]
    return F.coalesce(*cases, F.struct(F.lit("").alias("language"), F.lit("").alias("source")))


def item_type_of(title: Column, url: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", title, url)).rlike("expansi(o|ó)n"), "expansion").otherwise("unknown")


def platform_of_page(url: Column, html: Column, headers: Column | None = None) -> Column:
    """"amazon" by the host of the page's address; else the first platform that page, headers (as JSON) or address hold a marker of, else "custom"."""
    everything = F.lower(F.concat_ws("\n", html, F.coalesce(headers, F.lit("{}")) if headers is not None else F.lit("{}"), url))
    out = F.when(host(url).rlike(r"(?:^|\.)amazon\.[a-z.]+$"), "amazon")
    for name, marks in PLATFORM_MARKERS:
        out = out.when(any_word(everything, marks), name)
    return out.otherwise("custom")


def social_url(url: Column, site: str) -> Column:
    """The plain address of an account on ``site``, without query and further path; empty for posts, stories, share links and other sites."""
    name = F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*/+([^/?#]+)", 1)
    own = (canonical_domain(url) == f"{site}.com") & (name != "") & ~F.lower(name).isin(*NO_ACCOUNT[site])
    return F.when(own, F.concat(F.lit(f"https://{site}.com/"), name)).otherwise("")


def likes_of(text: Column) -> Column:
    """The number that "1.2K", "3M" or "1,204" stands for; 0 for anything else."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(?i)^\s*(\d+(?:\.\d+)?)\s*([km]?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(?i)^\s*(\d+(?:\.\d+)?)\s*([km]?)", 2))
    return F.coalesce(F.round(number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)).cast("long"), F.lit(0).cast("long"))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/video/(\d+)", 1), F.lit(""))


def money(value: Column) -> Column:
    """A finite amount of at least zero as decimal(12,2), else null."""
    amount = F.trim(value).try_cast("decimal(12,2)")
    return F.when(amount >= 0, amount)
