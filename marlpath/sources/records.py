"""Records in XML: parsed with a schema, in whatever order attributes stand, with names whose entities were encoded more than once."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import spread

_named = "struct<at_type: string, at_value: string>"
_value = "struct<at_value: string>"
#: The elements and attributes of a record, as far as they are read.
SCHEMA = (
    "item array<struct<at_id: string, at_type: string, description: string, image: string, thumbnail: string, "
    f"name: array<{_named}>, link: array<struct<at_type: string, at_id: string, at_value: string, at_inbound: string>>, "
    + ", ".join(f"{n}: {_value}" for n in ("yearpublished", "minplayers", "maxplayers", "playingtime", "minplaytime", "maxplaytime", "minage"))
    + f", statistics: struct<ratings: struct<average: {_value}, averageweight: {_value}>>>>, malformed string"
)


def decoded_text(text: str, times: int = 3) -> str:
    """``text`` with character entities decoded, over and over while that changes it, ``times`` at most."""
    for _ in range(times):
        if "&" not in text:
            break
        text = unescape(text)
    return text


def entities_decoded(texts: Column) -> Column:
    """An array of texts with the entities of each decoded and white space at the ends off; nulls are empty."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: None if own is None else [decoded_text((t or "").strip()) for t in own])

    return F.pandas_udf(run, "array<string>")(texts)


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def read(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents`` with ``item``, the first item of the record; null where the XML is malformed or holds none."""
    options = {"attributePrefix": "at_", "valueTag": "own_text", "columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"}
    parsed = documents.withColumn("_read", F.from_xml(F.col(xml), SCHEMA, options))
    return parsed.withColumn("item", F.when(F.col("_read.malformed").isNull(), F.get("_read.item", F.lit(0)))).drop("_read")


def things(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """What records say, one row for each external id (of several the last by text); malformed ones and those without an id are left out.

    external_id, kind, name, alternate_names, description, image, year, min_players, max_players, min_minutes, max_minutes,
    min_age, rating, weight, and links as an array of (pos, type, id, name, inbound): those with a positive id and a name.
    """
    found = read(documents.select(F.col(xml).alias("xml"))).withColumn("external_id", number(F.col("item.at_id")).cast("long"))
    # A plain condition would move below a repartition of the documents' own table, and the XML be parsed in its few tasks.
    found = found.where(F.when(F.spark_partition_id() >= 0, F.col("external_id") > 0))
    found = spread(found, "external_id", documents.count())  # so that each task sorts few of the wide rows
    item = found.groupBy("external_id").agg(F.max_by("item", "xml").alias("item"))
    none = F.array().cast(f"array<{_named}>")
    of = lambda kind: F.transform(F.filter(F.coalesce("item.name", none), lambda n: n["at_type"] == kind), lambda n: n["at_value"])
    no_link = F.array().cast("array<struct<at_type: string, at_id: string, at_value: string, at_inbound: string>>")
    item = item.withColumns({"_primary": F.slice(of("primary"), 1, 1), "_other": of("alternate"), "_links": F.coalesce("item.link", no_link)})
    texts = F.concat("_primary", "_other", F.transform("_links", lambda k: k["at_value"]))
    item = item.withColumn("_texts", entities_decoded(texts))
    value = lambda field: number(F.col(f"item.{field}.at_value"))
    said = lambda field: F.trim(F.coalesce(F.col(f"item.{field}"), F.lit("")))
    before = F.size("_primary") + F.size("_other")
    links = F.transform(
        "_links",
        lambda k, i: F.struct(
            i.alias("pos"), k["at_type"].alias("type"), number(k["at_id"]).cast("long").alias("id"), F.get(F.col("_texts"), before + i).alias("name"),
            (F.lower(F.trim(F.coalesce(k["at_inbound"], F.lit("")))) == "true").alias("inbound"),
        ),
    )
    return item.select(
        "external_id", F.col("item.at_type").alias("kind"), F.when(F.size("_primary") > 0, F.get("_texts", F.lit(0))).otherwise("").alias("name"),
        F.filter(F.slice("_texts", F.size("_primary") + 1, F.size("_other")), lambda n: n != "").alias("alternate_names"),
        said("description").alias("description"), F.when(said("image") != "", said("image")).otherwise(said("thumbnail")).alias("image"),
        value("yearpublished").cast("int").alias("year"), value("minplayers").cast("int").alias("min_players"), value("maxplayers").cast("int").alias("max_players"),
        F.coalesce(value("minplaytime"), value("playingtime")).cast("int").alias("min_minutes"), F.coalesce(value("maxplaytime"), value("playingtime")).cast("int").alias("max_minutes"),
        value("minage").cast("int").alias("min_age"), number(F.col("item.statistics.ratings.average.at_value")).alias("rating"), number(F.col("item.statistics.ratings.averageweight.at_value")).alias("weight"),
        F.filter(links, lambda k: (k["id"] > 0) & (k["name"] != "")).alias("links"),
    )


def related(things: DataFrame) -> DataFrame:
    """(bgg_id, pos, link_type, linked_bgg_id, inbound) of the links of things to expansions and implementations, in document order."""
    links = things.select(F.col("external_id").alias("bgg_id"), F.explode("links").alias("k"))
    kind = F.regexp_extract("k.type", "^boardgame(expansion|implementation)$", 1)
    return links.where(kind != "").select("bgg_id", "k.pos", F.when(kind == "expansion", "extension").otherwise("implementation").alias("link_type"), F.col("k.id").alias("linked_bgg_id"), "k.inbound")
