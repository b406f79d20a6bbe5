"""Payloads whose objects and lists hold places in one long list instead of values: followed by joins, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def place(node: Column) -> Column:
    """The place that a node names: a whole number, else null."""
    return F.when(F.schema_of_variant(node).isin("BIGINT", "TINYINT", "SMALLINT", "INT"), F.try_variant_get(node, "$", "long"))


def cells(payloads: DataFrame) -> DataFrame:
    """(id, at, kind, value, kids) of each entry of a payload (id, payload): kids are (name, to) of an object's or list's places; what isn't a JSON list gives none."""
    parsed = payloads.select("id", F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>").alias("list"))
    entry = parsed.select("id", F.posexplode("list").alias("at", "node"))
    of_object = F.transform(F.map_entries(F.try_variant_get("node", "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), place(e["value"]).alias("to")))
    of_list = F.transform(F.try_variant_get("node", "$", "array<variant>"), lambda v, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("name"), place(v).alias("to")))
    schema = F.schema_of_variant("node")
    kind = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "list").otherwise("value")
    kids = F.when(kind == "object", of_object).when(kind == "list", of_list)
    return entry.select("id", F.col("at").cast("long").alias("at"), kind.alias("kind"), F.when(kind == "value", F.try_variant_get("node", "$", "string")).alias("value"), kids.alias("kids"))


def values(payloads: DataFrame, depth: int = 64) -> DataFrame:
    """(id, path, value) of all that a payload's first entry leads to; ``path`` is an array of names, lists' as "[0]".

    An entry that stands above itself, or a place beyond the list, gives null; empty objects and lists give "{}" and "[]".
    Each level is a join of places with entries, merged: Spark takes the entries to be as few as the payloads. Raises where places lead deeper than ``depth``.
    """
    held = cut(cells(payloads))
    at = held.where("at = 0").select("id", F.array().cast("array<string>").alias("path"), F.array(F.lit(0).cast("long")).alias("above"), F.lit(0).cast("long").alias("at"))
    out = None
    for _ in range(depth):
        found = at.join(held.hint("merge"), ["id", "at"], "left")
        empty = F.when((F.col("kind") == "object") & (F.size("kids") == 0), "{}").when((F.col("kind") == "list") & (F.size("kids") == 0), "[]")
        leaf = found.where("kids is null or size(kids) = 0").select("id", "path", F.coalesce(empty, F.col("value")).alias("value"))
        kids = found.where("size(kids) > 0").select("id", "path", "above", F.explode("kids").alias("k"))
        kids = kids.select("id", F.concat("path", F.array("k.name")).alias("path"), "above", F.when(~F.array_contains("above", F.coalesce("k.to", F.lit(-1))), F.col("k.to")).alias("at"))
        own = kids.where("at is null").select("id", "path", F.lit(None).cast("string").alias("value"))
        leaf = leaf.unionByName(own)
        out = leaf if out is None else out.unionByName(leaf)
        at = cut(kids.where("at is not null").select("id", "path", F.concat("above", F.array("at")).alias("above"), "at"))
        if at.isEmpty():
            return out
    raise RuntimeError(f"a payload's places lead deeper than {depth} levels")


def product_descriptions(payloads: DataFrame) -> DataFrame:
    """(id, description) of payloads (id, slug, payload): that of the first object whose slug is the page's.

    Without one, the only text that holds markup and speaks of players or ages; empty with none or several.
    """
    held = cut(cells(payloads))
    texts = held.where("kind = 'value'").select("id", F.col("at").alias("to"), F.trim("value").alias("text"))
    fields = held.where("kind = 'object'").select("id", "at", F.explode("kids").alias("k")).where("k.name in ('slug', 'description')").select("id", "at", "k.name", "k.to")
    told = fields.join(texts.hint("merge"), ["id", "to"]).groupBy("id", "at").pivot("name", ["slug", "description"]).agg(F.first("text"))
    slugs = payloads.select("id", F.lower("slug").alias("wanted"))
    hit = told.join(slugs, "id").where((F.lower("slug") == F.col("wanted")) & (F.coalesce("description", F.lit("")) != ""))
    best = hit.groupBy("id").agg(F.min_by("description", "at").alias("own"))
    folded = F.lower(F.translate("text", "áéíóúÁÉÍÓÚ", "aeiouAEIOU"))
    spoken = texts.where(F.col("text").contains("<") & folded.rlike("numero de jugadores|edad recomendada")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("only"))
    return payloads.select("id").join(best, "id", "left").join(spoken, "id", "left").select("id", F.coalesce("own", F.when(F.col("n") == 1, F.col("only")), F.lit("")).alias("description"))
