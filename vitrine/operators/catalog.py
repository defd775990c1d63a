"""Catalog questions: inventory filters, lookups, stock reports.

Input is a catalog with the columns of ``schemas.CATALOG`` plus ``ord``.
Filters on flat columns (sku, category, price) reach the parquet scan; the
nested ones run in the same stage, so none of the filters here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import predicates as P


def check_inventory(
    catalog: DataFrame,
    sku: str | None = None,
    size: str | None = None,
    color: str | None = None,
    category: str | None = None,
    max_price: float | None = None,
    occasion: str | None = None,
) -> DataFrame:
    """Products in stock that meet every given filter.

    ``None`` and the empty string mean "no filter"; a price ceiling of zero is
    a filter.
    """
    wanted: list[Column] = [P.in_stock()]
    for value, predicate in (
        (sku, P.has_sku),
        (size, P.has_size),
        (color, P.has_color),
        (category, P.in_category),
        (occasion, P.has_occasion),
    ):
        if value:
            wanted.append(predicate(value))
    if max_price is not None:
        wanted.append(P.price_up_to(max_price))
    return catalog.filter(reduce(lambda a, b: a & b, wanted))


def product_by_sku(catalog: DataFrame, sku: str) -> DataFrame:
    """The first row in file order with this sku, or no row."""
    return catalog.filter(F.col("sku") == sku).orderBy("ord").limit(1)


def products_by_sku(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Batch lookup: every requested sku with its first catalog row; unknown ones vanish."""
    asked = requests.select("sku").distinct()
    rank = F.row_number().over(Window.partitionBy("sku").orderBy("ord"))
    return catalog.join(asked, "sku", "left_semi").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def low_stock(catalog: DataFrame, threshold: int = 3) -> DataFrame:
    """Products with any size at or below the threshold, and which sizes those are."""
    low = F.map_keys(F.map_filter("stock", lambda _, qty: qty <= threshold))
    return catalog.withColumn("low_stock_sizes", low).filter(F.size("low_stock_sizes") > 0)


def top_price(catalog: DataFrame, n: int = 1) -> DataFrame:
    return catalog.orderBy(F.desc_nulls_last("price_eur"), F.asc("ord")).limit(n)


def partial_stock(catalog: DataFrame) -> DataFrame:
    return catalog.filter(P.out_in_some_sizes())


def occasion_budget(catalog: DataFrame, occasion: str, max_price: float) -> DataFrame:
    return catalog.filter(P.has_occasion(occasion) & P.price_up_to(max_price))


def keyword_search(catalog: DataFrame, words: list[str]) -> DataFrame:
    return catalog.filter(P.mentions(words))


def any_occasion(catalog: DataFrame, occasions: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(o) for o in occasions])
    return catalog.filter(F.coalesce(F.arrays_overlap("occasion", wanted), F.lit(False)))


def all_occasions(catalog: DataFrame, occasions: list[str]) -> DataFrame:
    distinct = sorted(set(occasions))
    wanted = F.array(*[F.lit(o) for o in distinct])
    found = F.size(F.array_intersect("occasion", wanted))
    return catalog.filter(F.coalesce(found == len(distinct), F.lit(False)))


def size_availability(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each ``(sku, size)`` asked for: its quantity, a status, and the other sizes in stock.

    A sku that the catalog does not hold is not offered in any size.
    """
    qty = F.try_element_at("stock", F.col("size"))
    status = (
        F.when(qty.isNull(), "not offered").when(qty > 0, "available").otherwise("out of stock")
    )
    others = F.map_keys(F.map_filter("stock", lambda key, n: (n > 0) & (key != F.col("size"))))
    return requests.join(catalog, "sku", "left").select(
        "sku",
        "size",
        qty.alias("qty"),
        status.alias("status"),
        F.coalesce(others, F.array().cast("array<string>")).alias("other_sizes"),
    )


def alternatives_for(catalog: DataFrame, sku: str, size: str) -> DataFrame:
    """All other products that have the size in stock."""
    return catalog.filter((F.col("sku") != sku) & (F.try_element_at("stock", F.lit(size)) > 0))


def alternatives(requests: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """For each request whose size is out: the ``n`` cheapest other products having it.

    A product is a sku; of its rows with the size the cheapest stands for it.
    Instead of pairing every request with every product, the ``n + 1`` cheapest
    products of each size are ranked once (the rank limit is applied in every
    task before the shuffle) and joined by size; the spare one covers the
    request's own product.
    """
    out = size_availability(requests, catalog).filter("status = 'out of stock'").select("sku", "size")
    rows = catalog.select(
        F.col("sku").alias("alt_sku"),
        F.struct(
            F.col("price_eur").isNull().alias("unpriced"),
            F.col("price_eur").alias("alt_price"),
            "ord",
            F.col("name").alias("alt_name"),
        ).alias("row"),
        F.explode(F.map_keys(F.map_filter("stock", lambda _, qty: qty > 0))).alias("size"),
    )
    stocked = rows.groupBy("size", "alt_sku").agg(F.min("row").alias("row")).select("size", "alt_sku", "row.*")
    by_price = Window.partitionBy("size").orderBy(F.asc_nulls_last("alt_price"), "ord")
    best = stocked.withColumn("_rank", F.row_number().over(by_price)).filter(F.col("_rank") <= n + 1)
    # The self match can only push later entries up by one place, so the place
    # follows from the request's own rank and needs no second window.
    own = best.select("size", F.col("alt_sku").alias("sku"), F.col("_rank").alias("_own"))
    place = F.col("_rank") - F.when(F.col("_own") < F.col("_rank"), 1).otherwise(0)
    return (
        out.join(own, ["sku", "size"], "left")
        .join(best.drop("ord", "unpriced"), "size")
        .filter("alt_sku <> sku")
        .withColumn("place", place)
        .filter(F.col("place") <= n)
        .select("sku", "size", "place", "alt_sku", "alt_name", "alt_price")
    )
