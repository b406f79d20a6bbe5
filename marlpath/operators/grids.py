"""The grids that the service offers, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold_title_text
from .grid import GridColumn, GridSpec, plain_columns

#: The name of a front-page category: that of the taxonomy it belongs to.
NAME = "coalesce(category_name, family_name, mechanic_name, '')"

GRIDS = {
    "stores": GridSpec(plain_columns("id", "canonical_name", "canonical_domain", "country", "platform", "active"), "canonical_name", tiebreak="id"),
    "front_page_categories": GridSpec(plain_columns("id", "category_id", "category_type", "position", "title", "updated_at") | {"category_name": GridColumn(NAME, NAME)}, "position", tiebreak="id"),
    "store_candidates": GridSpec(plain_columns("id", "store_name", "canonical_domain", "confidence", "status", "last_seen_at"), "last_seen_at", True, "id"),
    "listings": GridSpec(
        plain_columns("id", "title", "store_id", "item_id", "source_url", "availability", "listing_status", "last_updated", "min_age", "publisher", "item_type")
        | {"price": GridColumn("concat_ws(' ', price, raw_price)", "price"), "players": GridColumn("concat_ws(' ', min_players, max_players)", "min_players")},
        "last_updated",
        True,
        "id",
    ),
    "items": GridSpec(
        plain_columns("id", "brand", "kind", "size", "item_type", "bgg_id")
        | {"name": GridColumn("concat_ws(' ', canonical_name, normalized_name)", "canonical_name", fold_title_text)},
        "name",
        tiebreak="id",
    ),
    "offer_reviews": GridSpec(plain_columns("id", "title", "store_id", "price", "listing_status", "is_boardgame_confirmed"), "id", True),
    "review_tasks": GridSpec(plain_columns("id", "task_type", "status", "created_at"), "created_at", True, "id"),
    "update_changes": GridSpec(plain_columns("id", "field_name", "old_value", "new_value", "changed_at"), "changed_at", True, "id"),
    "discovery_jobs": GridSpec(plain_columns("id", "store_id", "status", "started_at"), "started_at", True, "id"),
    "update_jobs": GridSpec(plain_columns("id", "run_id", "status", "started_at"), "started_at", True, "id"),
}


def scoped(name: str, column: str, value) -> GridSpec:
    """A grid over the rows of one owner, ties in the sort broken by id in the same direction."""
    spec = GRIDS[name]
    return GridSpec(spec.columns, spec.default_sort, spec.default_desc, "id", F.col(column) == value)
