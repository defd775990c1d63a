import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vitrine import schemas  # noqa: E402
from vitrine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The eight catalog rows the expected results refer to
# (sku, category, fabric, colors, price, stock, occasion).
PRODUCTS = [
    ("SK-001", "shalwar_kameez", "Cotton lawn", ["white", "off-white"], 49.9, {"S": 8, "M": 12, "L": 5, "XL": 3}, ["casual", "everyday"]),
    ("SK-002", "shalwar_kameez", "Cotton with embroidery", ["black"], 69.9, {"S": 4, "M": 2, "L": 0}, ["festive", "evening"]),
    ("SK-003", "kurta", "Linen blend", ["pink", "pastel"], 45.0, {"M": 6, "L": 9, "XL": 7}, ["casual", "summer"]),
    ("SK-004", "waistcoat_set", "Cotton blend", ["navy", "blue"], 79.9, {"M": 3, "L": 5, "XL": 2, "XXL": 1}, ["formal", "wedding"]),
    ("SK-005", "shawl", "Wool blend", ["maroon", "red", "gold"], 39.9, {"one_size": 10}, ["winter", "festive"]),
    ("SK-006", "lawn_suit", "Lawn", ["green", "printed"], 55.0, {"S": 0, "M": 4, "L": 6}, ["casual", "spring"]),
    ("SK-007", "lehenga", "Silk with heavy embroidery", ["beige", "gold"], 249.0, {"S": 1, "M": 2, "L": 1}, ["bridal", "wedding"]),
    ("SK-008", "kurta_pajama", "Cotton", ["grey", "charcoal"], 52.0, {"M": 7, "L": 8, "XL": 4, "XXL": 2}, ["casual", "everyday"]),
]


def as_products(spark, rows):
    """Rows of (ord, sku, name, category, fabric, colors, sizes, price, stock, care, occasion, description)."""
    from pyspark.sql import types as T

    pairs = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.IntegerType())]))
    fields = [T.StructField(f.name, pairs if f.name == "stock" else f.dataType) for f in schemas.CATALOG.fields]
    schema = T.StructType([T.StructField("ord", T.LongType()), *fields])
    # maps made from pairs keep their order, maps made from a dict need not
    listed = [tuple(list(v.items()) if isinstance(v, dict) else v for v in row) for row in rows]
    return spark.createDataFrame(listed, schema).withColumn("stock", F.map_from_entries("stock"))


@pytest.fixture(scope="session")
def shop(spark):
    rows = [
        (i, sku, f"Item {i}", category, fabric, colors, list(stock), price, stock, "wash cold", occasion, f"About {sku}")
        for i, (sku, category, fabric, colors, price, stock, occasion) in enumerate(PRODUCTS, 1)
    ]
    return as_products(spark, rows)


@pytest.fixture(scope="session")
def odd_shop(spark):
    """Missing lists, prices and stock, an awkward name, a negative count."""
    rows = [
        (1, "a", "100%_cotton", "top", "x", None, None, None, None, "", None, "d"),
        (2, "b", "plain", "top", "x", [], [], 10.0, {}, "", [], "d"),
        (3, "c", "zero", "top", "x", ["Off-White"], ["M"], 10.0, {"M": 0}, "", ["Eve_ning"], "d"),
        (4, "d", "minus", "top", "x", ["Off-White"], ["M"], 10.0, {"M": -1}, "", ["Eve_ning"], "d"),
        (5, "e", "free", "Top", "x", ["100%"], ["m"], 0.0, {"m": 1}, "", ["party"], "d"),
        (6, "e", "second e", "Top", "x", ["red"], ["m"], 12_345_678.5, {"m": 1, "L": 0}, "", ["party"], "d"),
    ]
    return as_products(spark, rows)


def skus(frame):
    return [r.sku for r in frame.orderBy("ord").select("sku").collect()]
