"""Vector expressions over ``array<float>`` columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(_doubles(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    values = _doubles(vector)
    # the length is bound once per row, not once per element
    pair = F.array(F.struct(values.alias("v"), norm(vector).alias("n")))
    scaled = F.transform(
        pair, lambda p: F.when(p["n"] == 0, p["v"]).otherwise(F.transform(p["v"], lambda x: x / p["n"]))
    )
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    """Null when one of the vectors has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
