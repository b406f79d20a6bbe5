"""Conditions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def refreshable() -> Column:
    """A listing that is kept up to date: a confirmed, matched, listed game with an address."""
    return (
        F.col("is_boardgame")
        & F.col("is_boardgame_confirmed")
        & F.col("item_id").isNotNull()
        & (F.col("source_url") != "")
        & (F.col("listing_status") == "LISTED")
    )


def platform_of(platform: Column, payload: Column) -> Column:
    """The store's platform; without one "shopify" if the payload mentions it, else "custom"."""
    return F.when(F.trim(platform) != "", platform).when(payload.ilike("%shopify%"), "shopify").otherwise("custom")


def change_event(field: Column, value: Column) -> Column:
    """What a change row says: a store's item switched on or off, an update without a field, or the field in words."""
    switched = F.when(field == "store_active", F.when(same_json(value, "false"), "Item deactivated").when(same_json(value, "true"), "Item activated"))
    return F.coalesce(switched, F.when(field == "", "Item updated").otherwise(F.concat(F.initcap(F.replace(field, F.lit("_"), F.lit(" "))), F.lit(" changed"))))


def unlike_sql(text: str) -> str:
    """``text`` with LIKE's wildcards and the escape itself escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_fold(column: Column, text: str) -> Column:
    """Case-insensitive containment of a literal text; a null column is the empty text."""
    return F.coalesce(column.cast("string"), F.lit("")).ilike(f"%{unlike_sql(text)}%")


def in_order(column: Column, tokens: list[str]) -> Column:
    """The tokens occur in this order, with anything between them."""
    return column.ilike("%" + "%".join(unlike_sql(t) for t in tokens) + "%")


def any_of(values: Column, wanted: list) -> Column:
    """The array holds one of the wanted values."""
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)


def none_of(value: Column, listed: Column) -> Column:
    """The value is in no entry of the array; an empty or null array lists nothing."""
    return ~F.coalesce(F.array_contains(listed, value), F.lit(False))


def starts_with(column: Column, text: str) -> Column:
    """The column begins with a literal text, whatever signs that has; a null column with none."""
    return F.coalesce(column, F.lit("")).startswith(text)


def same_json(column: Column, literal: str) -> Column:
    """Two JSON texts have one value, however they are spelled; what isn't JSON equals nothing."""
    spelled = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(spelled(column) == spelled(F.lit(literal)), F.lit(False))


def finite_number(column: Column) -> Column:
    """The number that a text spells, else null: no NaN, no infinity."""
    return F.when(F.trim(column).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(column).try_cast("double"))


def truthy(column: Column) -> Column:
    return F.lower(F.trim(column)).isin("true", "1", "on", "yes")


def whole_number(column: Column) -> Column:
    """The integer that a text spells, else null."""
    return F.when(F.trim(column).rlike(r"^[+-]?\d+$"), F.trim(column).try_cast("long"))


def listed_values(column: Column) -> Column:
    """Values parted by commas or line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(column, "[\n,]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
