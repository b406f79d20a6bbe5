"""Curated tables beside the catalogue: links, translations, details and lists in the order in which they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import latest
from .merge import insert_numbered, upsert
from .ranking import id_bucket


def parameters(spark: SparkSession, **values: Column) -> DataFrame:
    """One row of named parameters, to be joined where a query takes its values as a relation."""
    return spark.range(1).select(*[value.alias(name) for name, value in values.items()])


def links_after(links: DataFrame, items: DataFrame, new: DataFrame) -> DataFrame:
    """Tutorial links (id, item_id, url, title, language, source, status) after new ones (item_id, url, title, pos) were put in.

    A link of a known item and address takes the title; others of known items are added with new ids in the order of item and
    address. Of several with one address the last by pos counts. Links of unknown items are dropped.
    """
    known = new.join(items.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi")
    last = latest(known, ["item_id", "url"], F.col("pos").desc()).select("item_id", "url", "title", F.lit("es").alias("language"), F.lit("TIKTOK").alias("source"), F.lit("ACTIVE").alias("status"))
    fields = ["title", "language", "source", "status"]
    have = links.groupBy("item_id", "url").agg(F.min("id").alias("id"))
    changed = upsert(links, last.join(have, ["item_id", "url"]).select("id", *fields), ["id"], fields)
    fresh = insert_numbered(links, last.join(have, ["item_id", "url"], "left_anti"), [F.col("item_id"), F.col("url")], id_bucket("item_id"))
    return changed.unionByName(fresh.select(*links.columns))


TRANSLATION_KEY = ("source_text_hash", "source_language", "target_language", "purpose", "model", "prompt_version")


def cached_translations(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``requests`` (text, source_language, target_language, purpose, model, prompt_version and others) with source_text_hash and translated_text.

    Texts and languages are compared trimmed, languages in lower case; of completed jobs with one key the latest counts. Null without one.
    """
    low = lambda c: F.lower(F.trim(c))
    asked = requests.withColumns({"text": F.trim("text"), "source_language": low("source_language"), "target_language": low("target_language")})
    asked = asked.withColumn("source_text_hash", F.sha2("text", 256))
    done = latest(jobs.where("status = 'COMPLETED'"), list(TRANSLATION_KEY), F.col("updated_at").desc(), F.col("id").desc())
    return asked.join(done.select(*TRANSLATION_KEY, "translated_text"), list(TRANSLATION_KEY), "left")


DETAILS = ("min_players", "max_players", "min_minutes", "max_minutes", "min_age")


def normal_details(value) -> dict[str, Column]:
    """Details as whole numbers: players and minutes above 0, age 0 or more, and no pair whose bounds are the wrong way round. ``value`` maps a name to its column."""
    held = {n: F.when(value(n) == F.floor(value(n)), value(n)).cast("int") for n in DETAILS}
    held = {n: F.when(c >= (0 if n == "min_age" else 1), c) for n, c in held.items()}
    for kind in ("players", "minutes"):
        low, high = held[f"min_{kind}"], held[f"max_{kind}"]
        crossed = F.coalesce(low > high, F.lit(False))
        held[f"min_{kind}"], held[f"max_{kind}"] = F.when(~crossed, low), F.when(~crossed, high)
    return held


def merged_details(df: DataFrame, existing: str = "old_", extracted: str = "new_") -> DataFrame:
    """``df`` with DETAILS: the existing values, else the extracted ones, both normal before and after they are put together."""
    one = df.withColumns({f"_a_{n}": c for n, c in normal_details(lambda n: F.col(existing + n)).items()} | {f"_b_{n}": c for n, c in normal_details(lambda n: F.col(extracted + n)).items()})
    both = one.withColumns({f"_c_{n}": F.coalesce(f"_a_{n}", f"_b_{n}") for n in DETAILS})
    return both.withColumns(normal_details(lambda n: F.col(f"_c_{n}"))).drop(*[f"_{k}_{n}" for k in "abc" for n in DETAILS])


def listing_fallbacks(detail: Column, listing: Column, buyable: Column) -> Column:
    """struct(raw_price, price, price_source, availability, availability_source) of a fetched detail, what it lacks out of the listing.

    A marketplace's page that says out of stock and has no way to buy (``buyable`` false; null elsewhere) takes no price.
    """
    closed = (detail["availability"] == "out_of_stock") & F.coalesce(~buyable, F.lit(False))
    lacks = lambda name: ~closed & (F.coalesce(detail[name], F.lit("")) == "")
    unknown = detail["availability"] == "unknown"
    return F.struct(
        F.when(lacks("raw_price"), listing["raw_price"]).otherwise(detail["raw_price"]).alias("raw_price"),
        *[F.when(lacks("price"), listing[n]).otherwise(detail[n]).alias(n) for n in ("price", "price_source")],
        *[F.when(unknown, listing[n]).otherwise(detail[n]).alias(n) for n in ("availability", "availability_source")],
    )


def first_spellings(df: DataFrame, keys: list[str], spelling: Column, pos: str) -> DataFrame:
    """Of rows of ``keys`` that are spelled alike the first by ``pos``, without those spelled empty; their order is that of ``pos``."""
    return latest(df.withColumn("_spelled", spelling).where(F.coalesce("_spelled", F.lit("")) != ""), [*keys, "_spelled"], F.col(pos).asc()).drop("_spelled")


#: What stores are searched for by city and, in the widest scope, by state.
CITY_TEXTS = ("tienda juegos de mesa {} mexico", "juegos de mesa tienda online {}")
STATE_TEXTS = ("tienda juegos de mesa {} mexico", "comprar juegos de mesa {}")


def search_texts(core: DataFrame, cities: DataFrame, states: DataFrame, scope: str = "expanded") -> DataFrame:
    """(pos, text) of the searches for stores: ``core`` (pos, text), with "expanded" those of ``cities`` (pos, name), with "full" those of ``states`` too; of texts alike but for case the first."""
    if scope not in ("core", "expanded", "full"):
        raise ValueError("scope must be core, expanded or full")
    out = core.select(F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("n")).alias("pos"), "text")
    for part, (names, texts) in enumerate(((cities, CITY_TEXTS), (states, STATE_TEXTS))[: ("core", "expanded", "full").index(scope)], 1):
        made = F.posexplode(F.array(*[F.concat(F.lit(t.split("{}")[0]), F.col("name"), F.lit(t.split("{}")[1])) for t in texts]))
        out = out.unionByName(names.select("pos", made.alias("n", "text")).select(F.struct(F.lit(part).alias("part"), F.col("pos").cast("long").alias("pos"), "n").alias("pos"), "text"))
    return first_spellings(out, [], F.lower("text"), "pos")


def ranked_videos(videos: DataFrame) -> DataFrame:
    """``videos`` (item_id, video_id, pos, score, likes, url) with rank: each video of an item once, by score, likes and address."""
    once = latest(videos.where(F.coalesce("video_id", F.lit("")) != ""), ["item_id", "video_id"], F.col("pos").asc())
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("likes"), "url")
    return once.withColumn("rank", F.row_number().over(order))


def video_identity(url: Column) -> Column:
    """struct(user, video_id) out of a video's address; null for other addresses."""
    host_ok = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).rlike(r"tiktok\.com$")
    found = F.regexp_extract(url, r"^[^?#]*?//[^/?#]*/(?:[^?#]*?/)?@([^/?#]*)/video/(\d+)(?:[/?#]|$)", 2)
    user = F.regexp_extract(url, r"^[^?#]*?//[^/?#]*/(?:[^?#]*?/)?@([^/?#]*)/video/(\d+)(?:[/?#]|$)", 1)
    return F.when(host_ok & (found != ""), F.struct(user.alias("user"), found.alias("video_id")))


def json_without_nul(json: Column) -> Column:
    """A JSON text without the character U+0000 in any of its texts, however deep; an escaped backslash before "u0000" stays."""
    return F.regexp_replace(F.replace(json, F.lit("\0"), F.lit("")), r"(?<!\\)((?:\\\\)*)(?:\\u0000)+", "$1")


def deletion_counts(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(name, n): how many rows of each table name one of ``ids`` (item_id) in one of their ``keys``."""
    out = None
    for name, table in tables.items():
        held = table.withColumn("_n", F.monotonically_increasing_id())
        hit = held.select("_n", F.explode(F.array_distinct(F.array(*keys[name]))).alias("item_id")).join(ids.select("item_id").distinct(), "item_id", "left_semi").select("_n").distinct()
        own = hit.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out
