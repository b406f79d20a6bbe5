"""The order of a grid that is sorted where it is shown: numbers by value, texts by letter, whatever their case and accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import finite_number

#: Digits that runs of digits are filled up to.
DIGITS = 40


def natural_key(value: Column) -> Column:
    """What texts compare by: runs of digits as numbers, letters without case and accents (a collated string)."""
    runs = F.regexp_extract_all(value, F.lit(r"(\d+|\D+)"), 1)
    filled = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), DIGITS, "0")).otherwise(r))
    return F.collate(F.array_join(filled, ""), "UNICODE_CI_AI")


def shown_order(value: Column, descending: bool = False) -> list[Column]:
    """Sort columns for ``value``: texts and numbers ascending and empty ones last, or exactly the other way round.

    Two numbers compare by value, all else as ``natural_key``; numbers come before other texts.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    number = finite_number(text)
    keys = [text == "", number.isNull(), number, F.when(number.isNull(), natural_key(text))]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
