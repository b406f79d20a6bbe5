"""The grid query: filters, one sort column and a page over a whitelist of columns, with the total beside it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import contains_fold

DEFAULT_SIZE, MOST_SIZE, MOST_PAGE, DEFAULT_ROWS = 25, 200, 100_000, 200


@dataclass(frozen=True)
class GridColumn:
    """What a column id filters and sorts by, as SQL expressions; ``fold`` turns a filter value into the form that the column holds."""

    filter_by: str | None = None
    sort_by: str | None = None
    fold: Callable[[str], str] = str


@dataclass(frozen=True)
class GridSpec:
    columns: Mapping[str, GridColumn]
    default_sort: str
    default_desc: bool = False
    tiebreak: str | None = None
    where: Column | None = None


@dataclass(frozen=True)
class GridRequest:
    page: str | int | None = None
    page_size: str | int | None = None
    sort: str | None = None
    sort_direction: str | None = None
    filters: Mapping[str, str] = field(default_factory=dict)

    def asks_for_grid(self) -> bool:
        return any(x is not None for x in (self.page, self.page_size, self.sort)) or bool(self.filters)


def plain_columns(*names: str) -> dict[str, GridColumn]:
    return {n: GridColumn(n, n) for n in names}


def bounded(value: str | int | None, default: int, low: int, high: int) -> int:
    """A whole number within bounds; anything else is the default."""
    text = str(value).strip() if value is not None else ""
    digits = text[1:] if text[:1] in "+-" else text
    return min(high, max(low, int(text))) if digits.isdecimal() and digits.isascii() else default


def filtered(df: DataFrame, spec: GridSpec, request: GridRequest) -> DataFrame:
    """The rows that every known filter lets through; unknown columns and empty values filter nothing."""
    if spec.where is not None:
        df = df.where(spec.where)
    for name, value in request.filters.items():
        column = spec.columns.get(name)
        if column is not None and column.filter_by is not None and str(value).strip():
            df = df.where(contains_fold(F.expr(column.filter_by), column.fold(str(value).strip())))
    return df


def ordered(df: DataFrame, spec: GridSpec, request: GridRequest) -> DataFrame:
    """Sorted as asked; an unknown column means the default column in its default direction. Nulls come last upwards, first downwards."""
    known = request.sort in spec.columns and spec.columns[request.sort].sort_by is not None
    column = F.expr(spec.columns[request.sort if known else spec.default_sort].sort_by)
    desc = request.sort_direction == "desc" if known else spec.default_desc
    turn = (lambda c: c.desc_nulls_first()) if desc else (lambda c: c.asc_nulls_last())
    keys = [turn(column)]
    if spec.tiebreak:
        keys.append(turn(F.col(spec.tiebreak)))
    return df.orderBy(*keys)


def page(df: DataFrame, spec: GridSpec, request: GridRequest) -> DataFrame:
    """One page; without any request the default scan of the first rows. The sort and the limit become a top-k."""
    rows = ordered(filtered(df, spec, request), spec, request)
    if not request.asks_for_grid():
        return rows.limit(DEFAULT_ROWS)
    size = bounded(request.page_size, DEFAULT_SIZE, 1, MOST_SIZE)
    start = bounded(request.page, 0, 0, MOST_PAGE) * size
    return rows.offset(start).limit(size) if start else rows.limit(size)


def total(df: DataFrame, spec: GridSpec, request: GridRequest) -> DataFrame:
    return filtered(df, spec, request).agg(F.count(F.lit(1)).alias("total"))


def keyset_page(df: DataFrame, after: int, size: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(entries, one row of has_more and next_cursor) after a cursor: one row more than a page tells if there is more."""
    ahead = df.where(F.col(key) > after).orderBy(key).limit(size + 1)
    entries = ahead.orderBy(key).limit(size)
    state = ahead.agg((F.count(F.lit(1)) > size).alias("has_more")).crossJoin(entries.agg(F.coalesce(F.max(key), F.lit(after)).alias("next_cursor")))
    return entries, state
