"""Page, sitemap, XML and JSON sources, and exports: text columns in, typed rows out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offers import availability_of, clean_url, is_product_url, price_of
from ..functions.text import collapse

BEFORE, AFTER = 3, 7
#: Characters of links that a worker holds before it hands them on.
HELD = 1_000_000
LINKS = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("url", pa.string()), ("title", pa.string()), ("context", pa.string())])


class _Links(HTMLParser):
    """A page's links and texts in order, as ("link", address, text) and ("text", "", text)."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.events, self.href, self.held, self.hidden = base, [], None, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a":
            self.href, self.held = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.href is not None:
            self.events.append(("link", urljoin(self.base, self.href), " ".join(" ".join(self.held).split())))
            self.href = None

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        if self.href is not None:
            self.held.append(data)
        else:
            self.events.append(("text", "", " ".join(data.split())))


def near_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of pages (page_id, url, html), taken from a batch one page at a time and handed on whenever their texts exceed HELD characters."""
    rows, held = [], 0
    for batch in batches:
        for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
            parser = _Links(url.as_py() or "")
            parser.feed(html.as_py() or "")
            events = parser.events
            for i, (kind, target, title) in enumerate(events):
                if kind != "link":
                    continue
                near = []
                for e in reversed(events[max(0, i - BEFORE) : i]):
                    if e[0] == "link":
                        break
                    near.insert(0, e[2])
                for e in events[i + 1 : i + 1 + AFTER]:
                    if e[0] == "link":
                        break
                    near.append(e[2])
                rows.append((page_id.as_py(), i, target, title, " ".join(near)))
                held += sum(map(len, rows[-1][2:]))
                if held > HELD:
                    yield pa.record_batch(list(zip(*rows)), schema=LINKS)
                    rows, held = [], 0
    if rows:
        yield pa.record_batch(list(zip(*rows)), schema=LINKS)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, title, context) of each link; context is the text around it up to the next link, 3 before and 7 after at most."""
    return pages.select("page_id", "url", "html").mapInArrow(near_links, "page_id long, pos int, url string, title string, context string")


def listing_candidates(pages: DataFrame) -> DataFrame:
    """Product links of listing pages, one for each page and address, with price and availability from the text around them."""
    found = page_links(pages).where(is_product_url(F.col("url"))).withColumn("source_url", clean_url(F.col("url")))
    first = found.groupBy("page_id", "source_url").agg(F.min(F.struct("pos", "title", "context")).alias("f"))
    text = F.concat_ws(" ", "f.title", "f.context")
    return first.select("page_id", "source_url", "f.title", price_of(text)["price"].alias("price"), availability_of(text).alias("availability"))


def sitemap_urls(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """(domain, url, is_map) of the distinct addresses in sitemaps that are on the sitemap's own host."""
    locs = documents.select("domain", F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))
    own = locs.where(F.regexp_replace(F.try_parse_url("url", F.lit("HOST")), r"^www\.", "") == F.regexp_replace("domain", r"^www\.", ""))
    return own.select("domain", F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"), F.col("url").rlike(r"(?i)\.xml(\.gz)?$").alias("is_map")).distinct()


def json_rows(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """A row for each element of a JSON array of objects, typed; malformed arrays give none."""
    return df.select("*", F.inline(F.from_json(F.col(column), f"array<struct<{ddl}>>")))


def json_ld_price(payload: Column) -> Column:
    """The offer's price in a product's JSON-LD, whose numbers may wrongly begin with zeros."""
    repaired = F.regexp_replace(payload, r'("gtin\d*"\s*:\s*)(0\d+)', '$1"$2"')
    path = lambda p: F.get_json_object(repaired, p)
    return F.replace(F.coalesce(path("$.offers.price"), path("$.offers[0].price"), path("$.offers.lowPrice"), F.lit("")), F.lit(","), F.lit(""))


def catalogue_faults(pages: DataFrame) -> DataFrame:
    """(store_id, fault) of paged catalogues (store_id, page, declared, page_size, key) that aren't whole.

    The declared total must be the same on all pages, the number of different keys must equal it, and every page but the
    last must be full.
    """
    by_page = pages.groupBy("store_id", "page", "page_size").agg(F.count(F.lit(1)).alias("n"))
    edge = by_page.groupBy("store_id").agg(F.max("page").alias("last"))
    short = by_page.join(edge, "store_id").where((F.col("page") < F.col("last")) & (F.col("n") != F.col("page_size"))).select("store_id").distinct()
    sums = pages.groupBy("store_id").agg(F.min("declared").alias("lo"), F.max("declared").alias("hi"), F.countDistinct("key").alias("keys"))
    totals = sums.select("store_id", F.when(F.col("lo") != F.col("hi"), "total changed").when(F.col("keys") != F.col("hi"), "keys missing").alias("fault"))
    return totals.where("fault is not null").unionByName(short.select("store_id", F.lit("short page").alias("fault")))


def domain_buckets(results: DataFrame, domain: Column) -> DataFrame:
    """The first search result of each domain, and how many it had."""
    return results.withColumn("domain", domain).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "pos").alias("first_url"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def export_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays, one for each output file, of that file's rows."""
    rows = df.select(F.to_json(F.struct("*")).alias("row")).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("row").alias("rows"))
    rows.select(F.concat(F.lit("[\n  "), F.array_join("rows", ",\n  "), F.lit("\n]")).alias("value")).write.option("lineSep", "\n").text(path)


def append_events(df: DataFrame, path: str, started: Column, at: Column) -> bool:
    """Appends trace rows with elapsed_ms; a failure to write is reported and not raised."""
    try:
        df.withColumn("elapsed_ms", F.floor((F.unix_micros(at) - F.unix_micros(started)) / 1000).cast("long")).write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001  traces are best effort
        return False


def site_title(html: Column) -> Column:
    """A page's name: og:site_name, else its title up to a separator."""
    named = F.regexp_extract(html, r'(?is)<meta[^>]+property="og:site_name"[^>]+content="([^"]*)"', 1)
    title = collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(named != "", named).otherwise(F.trim(F.regexp_replace(title, r"\s[|–—-]\s.*$", "")))
