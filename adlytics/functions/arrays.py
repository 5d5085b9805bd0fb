"""Reading nested bid arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_field(items: Column, field: str, where: Callable[[Column], Column] | None = None) -> Column:
    """Largest non-null value of a field; NULL for a missing or empty array."""
    kept = items if where is None else F.filter(items, where)
    return F.array_max(F.transform(kept, lambda item: item[field]))


def true_if_any(items: Column, test: Callable[[Column], Column]) -> Column:
    """TRUE when some element passes, otherwise NULL; never FALSE."""
    return F.when(F.exists(items, test), F.lit(True))


def first_field(items: Column, field: str, where: Callable[[Column], Column] | None = None) -> Column:
    kept = items if where is None else F.filter(items, where)
    return F.get(kept, F.lit(0))[field]


def count_equal(items: Column, value: str) -> Column:
    """Number of elements equal to a value; 0 for a missing array."""
    return F.coalesce(F.array_size(F.filter(items, lambda x: x == F.lit(value))), F.lit(0))


def distinct_values(values: Column, empty: str = "null") -> Column:
    """Aggregate: sorted distinct non-null values.

    ``empty`` says what a group without values yields: ``"null"`` (as an aggregate does
    inside a query) or ``"empty"`` (as the same array reads back from a stored table).
    """
    found = F.sort_array(F.collect_set(values))
    return _apply_empty(found, empty)


def _apply_empty(found: Column, empty: str) -> Column:
    if empty == "empty":
        return found
    if empty == "null":
        return F.when(F.size(found) > 0, found)
    raise ValueError("empty must be 'null' or 'empty'")


def merge_distinct(*arrays: Column, empty: str = "null") -> Column:
    """Sorted distinct union of arrays, a missing one counting as empty."""
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(a, none) for a in arrays])))
    return _apply_empty(merged, empty)
