"""JSON of storefronts and catalogue services to listing rows, and the marketplace's own detail rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offers import canonical_domain, money
from ..functions.text import collapse, fold_title

#: The shape of a storefront's product answer; anything else in it is ignored.
STOREFRONT = (
    "data struct<product: struct<title: string, description: string, vendor: string, availableForSale: boolean, featuredImage: struct<url: string>, "
    "priceRange: struct<minVariantPrice: struct<amount: string, currencyCode: string>>, variants: struct<nodes: array<struct<sku: string>>>>>"
)
#: The shape of one entry in paged catalogue services.
CATALOGUE = "products array<struct<id: string, name: string, permalink: string, price: string, in_stock: boolean, brand: string>>, total int, page int, per_page int"


def storefront_products(answers: DataFrame) -> DataFrame:
    """Listing rows of storefront answers (store_id, url, body) whose product has a title; malformed and empty answers give none."""
    p = F.col("p")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    parsed = answers.select("store_id", "url", F.from_json("body", STOREFRONT)["data"]["product"].alias("p")).where(text(p["title"]) != "")
    return parsed.select(
        "store_id", F.col("url").alias("source_url"), text(p["title"]).alias("title"), text(p["description"]).alias("description"), text(p["vendor"]).alias("publisher"),
        text(p["featuredImage"]["url"]).alias("image_url"), F.coalesce(money(p["priceRange"]["minVariantPrice"]["amount"]).cast("string"), F.lit("")).alias("price"),
        F.coalesce(F.nullif(text(p["priceRange"]["minVariantPrice"]["currencyCode"]), F.lit("")), F.lit("MXN")).alias("currency"),
        F.when(F.coalesce(p["availableForSale"], F.lit(False)), "available").otherwise("out_of_stock").alias("availability"),
        text(F.get(p["variants"]["nodes"], F.lit(0))["sku"]).alias("store_sku"),
    )


def catalogue_products(answers: DataFrame) -> DataFrame:
    """(store_id, page, declared, page_size, key, title, source_url, price, availability, publisher) of catalogue pages (store_id, body), for catalogue_faults and the listings."""
    parsed = answers.select("store_id", F.from_json("body", CATALOGUE).alias("b")).select("store_id", "b.page", F.col("b.total").alias("declared"), F.col("b.per_page").alias("page_size"), F.explode("b.products").alias("p"))
    return parsed.where("p.id is not null").select(
        "store_id", "page", "declared", "page_size", F.col("p.id").alias("key"), collapse(F.col("p.name")).alias("title"), F.col("p.permalink").alias("source_url"),
        money(F.replace("p.price", F.lit(","), F.lit(""))).alias("price"), F.when(F.col("p.in_stock"), "available").otherwise("out_of_stock").alias("availability"), F.coalesce("p.brand", F.lit("")).alias("publisher"),
    )


def brand_of_byline(byline: Column) -> Column:
    """The brand in "Marca: X", "Visita la tienda de X" or "Visit the X Store", else the byline itself."""
    line = collapse(byline)
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (r"(?i)^(?:marca|brand)\s*:\s*(.+)$", r"(?i)^visita\s+la\s+tienda\s+de\s+(.+)$", r"(?i)^visit\s+the\s+(.+?)\s+store$")]
    return collapse(F.coalesce(*found, line))


def brand_matches(byline: Column, expected: Column) -> Column:
    """The byline's brand is the expected one, folded; an empty expectation matches nothing."""
    return (fold_title(expected) != "") & (fold_title(brand_of_byline(byline)) == fold_title(expected))


def number_range(value: Column) -> Column:
    """(min, max) of "2 a 4", "2-4", "2 to 4" or of a single number."""
    span, one = r"(?i)(\d+)\s*(?:-|–|a|to|hasta)\s*(\d+)", r"(\d+)"
    pick = lambda p, i: F.nullif(F.regexp_extract(value, p, i), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(pick(span, 1), pick(one, 1)).alias("min"), F.coalesce(pick(span, 2), pick(one, 1)).alias("max"))


def age_in_years(value: Column) -> Column:
    """A stated age in years; months, and numbers over 30 without a unit, are divided by twelve and rounded half to even, 1 at least."""
    age = F.nullif(F.regexp_extract(value, r"(\d+)", 1), F.lit("")).try_cast("int")
    low = F.lower(value)
    months = low.rlike("mes|month") | ((age > 30) & ~low.rlike("a(ñ|n)o|year"))
    return F.when(months, F.greatest(F.lit(1), F.bround(age / 12.0).cast("int"))).otherwise(age)


def buy_box(price: Column, can_buy: Column) -> Column:
    """(price, availability): without a way to buy, a marketplace page has no price and is out of stock."""
    ok = F.coalesce(can_buy, F.lit(False))
    return F.struct(F.when(ok, price).otherwise("").alias("price"), F.when(ok, "available").otherwise("out_of_stock").alias("availability"))


#: The shapes of two further catalogue services: pages of a numbered whole, and pages of a category.
WHOLE = (
    "content array<struct<id: string, name: string, slug: string, price: string, brand: string, longDescription: string, shortDescription: string, imageUrl: string, "
    "availableOnline: boolean, stock: double>>, number int, totalPages int, totalElements int"
)
CATEGORY = "status boolean, items array<struct<id_product: string, name: string, link: string, price_amount: string, stock: string, description_short: string, cover: string, reference: string>>, total int"


#: Bytes of answers whose products one task groups.
DEALT = 16_000_000


def plain_amount(value: Column) -> Column:
    """A finite amount of at least zero without zeros at the end, as text; empty for anything else."""
    amount = F.trim(value).try_cast("decimal(30,10)")
    return F.when(amount >= 0, F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise("")


def whole_catalogue(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing rows, faults) of answers (store_id, store_url, page, body): the pages, from 0, of a catalogue that says how many pages and products it has.

    A page that isn't JSON, lacks a list or a number, or says another number than its own is a fault of its store, as is
    a total that changes or isn't that of the different products. Products without name or slug are left out.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parsed = answers.select("store_id", "store_url", "page", F.from_json("body", WHOLE).alias("b"))
    shape = F.col("b.content").isNull() | F.col("b.number").isNull() | F.col("b.totalPages").isNull() | F.col("b.totalElements").isNull()
    checked = parsed.withColumn("fault", F.when(shape, "invalid response").when(F.col("b.number") != F.col("page"), "another page"))
    entry = checked.where("fault is null").select("store_id", "store_url", F.explode("b.content").alias("p"))
    slug = F.regexp_replace(text(F.col("p.slug")), "^/+|/+$", "")
    stock = F.when(F.col("p.stock").isNotNull(), F.when(F.col("p.stock") > 0, "available").otherwise("out_of_stock"))
    available = F.when(F.col("p.availableOnline") == F.lit(False), "out_of_stock").otherwise(F.coalesce(stock, F.when(F.col("p.availableOnline"), "available").otherwise("unknown")))
    price = plain_amount(F.col("p.price"))
    rows = entry.where((text(F.col("p.name")) != "") & (slug != "")).select(
        "store_id", F.concat(F.regexp_replace("store_url", r"^([a-z]+://[^/]+).*$", "$1"), F.lit("/product/"), F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20"))).alias("source_url"),
        text(F.col("p.name")).alias("title"), text(F.col("p.brand")).alias("publisher"), F.coalesce(F.nullif(text(F.col("p.longDescription")), F.lit("")), text(F.col("p.shortDescription"))).alias("description"),
        text(F.col("p.imageUrl")).alias("image_url"), price.alias("price"), F.when(price != "", "catalogue").otherwise("none").alias("price_source"), available.alias("availability"), text(F.col("p.id")).alias("store_sku"),
    )
    products = checked.where("fault is null").select("store_id", F.explode("b.content.slug").alias("slug")).groupBy("store_id").agg(F.countDistinct("slug").alias("n"))
    totals = checked.where("fault is null").groupBy("store_id").agg(F.min("b.totalElements").alias("lo"), F.max("b.totalElements").alias("hi"), F.max("b.totalPages").alias("pages"), F.countDistinct("page").alias("read"))
    whole = totals.join(products, "store_id", "left").select(
        "store_id", F.when(F.col("lo") != F.col("hi"), "total changed").when(F.col("read") < F.col("pages"), "pages missing").when(F.coalesce("n", F.lit(0)) != F.col("hi"), "products missing").alias("fault")
    )
    faults = checked.where("fault is not null").select("store_id", "fault").distinct().unionByName(whole.where("fault is not null"))
    return rows, faults


def category_catalogue(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing rows, faults) of answers (store_id, store_url, category, page, body): the pages of categories, of which a product may stand in several.

    A page that isn't JSON, isn't ready, or lacks a list or total is a fault, as is a product without id, name or address, or whose
    address is on another domain or doesn't begin with its id. A product in several categories counts once, in the first.
    Products are dealt over tasks of some DEALT bytes of answers, in which they are sorted.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parsed = answers.select("store_id", "store_url", "category", "page", F.from_json("body", CATEGORY).alias("b"))
    bad = ~F.coalesce(F.col("b.status"), F.lit(False)) | F.col("b.items").isNull() | F.coalesce(F.col("b.total") < 0, F.lit(True))
    entry = parsed.where(~bad).select("store_id", "store_url", "category", "page", F.posexplode("b.items").alias("pos", "p"))
    link = F.regexp_replace(F.when(text(F.col("p.link")).rlike("^https?://[^/]"), text(F.col("p.link"))).otherwise(""), "[;?#].*$", "")
    number = text(F.col("p.id_product"))
    entry = entry.withColumns({"url": link, "number": number, "name": text(F.col("p.name"))})
    file = F.lower(F.element_at(F.split("url", "/"), -1))
    fault = (
        F.when((F.col("number") == "") | (F.col("name") == "") | (F.col("url") == ""), "incomplete product")
        .when(canonical_domain(F.col("url")) != canonical_domain(F.col("store_url")), "another domain")
        .when(~(file.startswith(F.concat(F.lower("number"), F.lit("-"))) & file.endswith(".html")), "another product's address")
    )
    entry = entry.withColumn("fault", fault)
    price, stock = F.col("p.price_amount").try_cast("decimal(30,10)"), text(F.col("p.stock")).try_cast("decimal(30,10)")
    amount = F.when(price >= 0, price.cast("decimal(12,2)").cast("string")).otherwise("")
    size = answers.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    dealt = entry.where("fault is null").repartition(-(-size // DEALT) or 1, "number")
    first = dealt.groupBy("store_id", "number").agg(F.min_by(F.struct("url", "name", "category", "p"), F.struct("category", "page", "pos")).alias("f")).select("store_id", "number", "f.*")
    rows = first.select(
        "store_id", F.col("url").alias("source_url"), "category", F.col("name").alias("title"), text(F.col("p.description_short")).alias("description"), text(F.col("p.cover")).alias("image_url"), amount.alias("price"),
        F.when(stock.isNull(), "unknown").when(stock > 0, "available").otherwise("out_of_stock").alias("availability"), F.col("number").alias("store_sku"),
    )
    faults = parsed.where(bad).select("store_id", F.lit("unavailable").alias("fault")).unionByName(entry.where("fault is not null").select("store_id", "fault")).distinct()
    return rows, faults
