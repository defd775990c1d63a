"""Catalog predicates as Column builders.

Predicates on flat columns are plain comparisons, which Spark pushes into the
scan; as a filter, a missing value does not match.  Predicates on lists and
maps cannot be pushed and are false instead of null, so a missing list or map
does not match either, also below a negation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_sku(sku: str) -> Column:
    return F.col("sku") == sku


def has_size(size: str | Column) -> Column:
    """The size is listed, exactly and case-sensitively; it may still be out of stock."""
    return _false_if_null(F.array_contains("sizes", size))


def _any_contains(column: str, word: str) -> Column:
    # contains, not LIKE: the word may hold % or _
    needle = F.lit(word.lower())
    return _false_if_null(F.exists(column, lambda item: F.lower(item).contains(needle)))


def has_color(color: str) -> Column:
    """Any colour holds the word as a substring, so "white" also finds "off-white"."""
    return _any_contains("colors", color)


def has_occasion(occasion: str) -> Column:
    return _any_contains("occasion", occasion)


def in_category(category: str) -> Column:
    return F.col("category") == category


def price_up_to(ceiling: float) -> Column:
    return F.col("price_eur") <= ceiling


def in_stock() -> Column:
    """Some size has a quantity other than zero; a negative count is not zero."""
    return _false_if_null(F.exists(F.map_values("stock"), lambda qty: qty != 0))


def out_in_some_sizes() -> Column:
    """At least one size is at zero while another one is above it."""
    quantities = F.map_values("stock")
    return _false_if_null(F.exists(quantities, lambda q: q == 0) & F.exists(quantities, lambda q: q > 0))


def mentions(words: list[str], columns: tuple[str, ...] = ("fabric", "short_description")) -> Column:
    """Any of the words occurs in any of the text columns, ignoring case."""
    haystack = F.lower(F.concat_ws(" ", *columns))
    hit = F.lit(False)
    for word in words:
        hit = hit | haystack.contains(word.lower())
    return hit
