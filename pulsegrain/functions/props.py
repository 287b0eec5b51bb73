"""Reading and merging the event property map."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def prop(name: str, col: str = "properties") -> Column:
    """Property as text; an absent key reads as ''."""
    return F.coalesce(F.col(col)[name], F.lit(""))


def prop_num(name: str, col: str = "properties") -> Column:
    """Property as a number, NULL when absent or not numeric."""
    return F.col(col)[name].try_cast("double")


def merge_maps(defaults: Column, own: Column) -> Column:
    """Union of two maps, the right one winning on shared keys.

    Shared keys are removed from the left side first, so the result does not depend on
    ``spark.sql.mapKeyDedupPolicy`` (whose default raises on duplicates).
    """
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(defaults, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def props_key(col: str = "properties") -> Column:
    """Canonical text of a property map: equal maps give equal text whatever their key order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(col))))
