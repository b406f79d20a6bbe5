"""Sitemaps that name further sitemaps: walked level by level over fetched documents, all sites at once."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offers import canonical_domain, is_product_url
from ..operators.lineage import cut

#: Where a site's first map is, and where its products may be listed without being named there.
ROOT, DIRECT = "/sitemap.xml", "/product-sitemap.xml"


def unescaped(text: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(unescape, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def locations(text: Column) -> Column:
    """The addresses in a map, in order, as they stand in its XML; CDATA marks are taken off."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<loc(?:\s[^>]*)?>\s*(.*?)\s*</loc>"), 1)
    return F.transform(found, lambda v: F.trim(F.regexp_replace(v, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")))


def entries(documents: DataFrame) -> DataFrame:
    """(url, pos, target, own, is_map, is_product) of each address in the documents (url, text); those that begin with "/" are of the map's own site."""
    # What is asked of a whole map is asked before its addresses are parted, or each of them would carry the map's text along.
    maps = documents.select("url", F.coalesce("text", F.lit("")).alias("text")).select("url", F.lower("text").contains("<sitemap").alias("names_maps"), locations(F.col("text")).alias("found"))
    found = maps.select("url", "names_maps", F.posexplode("found").alias("pos", "raw"))
    found = found.withColumn("target", unescaped(F.col("raw")))
    found = found.withColumn("target", F.when(F.col("target").startswith("/"), F.concat(origin(F.col("url")), "target")).otherwise(F.col("target")))
    clean = F.regexp_replace("target", r"[;?#].*$", "")
    return found.select(
        "url", "pos", "target", clean.alias("clean"), canonical_domain(F.col("target")).alias("domain"),
        (F.col("names_maps") & F.lower("target").contains("sitemap")).alias("is_map"), is_product_url(clean).alias("is_product"),
    )


def product_addresses(stores: DataFrame, documents: DataFrame, limit: int | None = None, rounds: int = 100) -> DataFrame:
    """(store_id, pos, url): the product addresses of each store (store_id, store_url), in the order in which its maps are read, each once.

    The root map's products come first. Of the maps that it names those with "product" in their address are read, if there
    are none all, and then the usual product map; further maps that these name follow in the order in which they are
    found, each once, so cycles end. With ``limit`` no map is opened once so many addresses were read, and so many are returned.
    Only addresses on the store's own domain count. Every level is a join of its maps' addresses with the documents.
    """
    links = cut(entries(documents))
    products = links.where("is_product").select("url", "pos", "domain", F.col("clean").alias("product"))
    maps = links.where("is_map").select("url", "pos", "domain", "target")
    counts = products.groupBy("url", "domain").agg(F.count(F.lit(1)).alias("n"))
    fetched = documents.select("url").distinct()
    site = stores.select("store_id", canonical_domain(F.col("store_url")).alias("domain"), origin(F.col("store_url")).alias("origin"))
    now = site.select("store_id", "domain", F.concat("origin", F.lit(ROOT)).alias("url"), F.lit(0).cast("long").alias("turn"))
    visited, opened, level = now.select("store_id", "url"), None, 0
    by_store = Window.partitionBy("store_id").orderBy("turn")
    read_before = site.select("store_id", F.lit(0).cast("long").alias("read"))
    last = read_before.select("store_id", F.lit(0).cast("long").alias("last"))
    while level < rounds:
        here = now.join(fetched, "url", "left_semi").join(counts, ["url", "domain"], "left").join(read_before, "store_id").withColumn("n", F.coalesce("n", F.lit(0)))
        before = F.col("read") + F.coalesce(F.sum("n").over(by_store.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = here.withColumn("before", before)
        if limit is not None and level:
            here = here.where(F.col("before") < limit)
        here = cut(here.select("store_id", "domain", "url", "turn", "n"))
        opened = here if opened is None else opened.union(here)
        sums = here.groupBy("store_id").agg(F.sum("n").alias("more"))
        read_before = cut(read_before.join(sums, "store_id", "left").select("store_id", (F.col("read") + F.coalesce("more", F.lit(0))).alias("read")))
        named = here.join(maps, ["url", "domain"]).select("store_id", "domain", F.col("target").alias("url"), F.struct("turn", "pos").alias("order"))
        if level == 0:
            of_products = named.where(F.lower("url").contains("product"))
            rest = named.join(of_products.select("store_id").distinct(), "store_id", "left_anti")
            direct = site.select("store_id", "domain", F.concat("origin", F.lit(DIRECT)).alias("url"), F.struct(F.lit(1).cast("long").alias("turn"), F.lit(0).alias("pos")).alias("order"))
            named = of_products.union(rest).union(direct)
        new = named.join(visited, ["store_id", "url"], "left_anti").groupBy("store_id", "domain", "url").agg(F.min("order").alias("order"))
        turn = F.row_number().over(Window.partitionBy("store_id").orderBy("order")) + F.col("last")
        now = cut(new.join(last, "store_id").select("store_id", "domain", "url", turn.cast("long").alias("turn")))
        if now.isEmpty():
            break
        visited = cut(visited.union(now.select("store_id", "url")))
        last = cut(last.join(now.groupBy("store_id").agg(F.max("turn").alias("top")), "store_id", "left").select("store_id", F.coalesce("top", "last").alias("last")))
        level += 1
    else:
        raise RuntimeError(f"sitemaps did not end in {rounds} levels")
    first = opened.join(products, ["url", "domain"]).groupBy("store_id", "product").agg(F.min(F.struct("turn", "pos")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("store_id").orderBy("at")))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("store_id", (F.col("rank") - 1).alias("pos"), F.col("product").alias("url"))
