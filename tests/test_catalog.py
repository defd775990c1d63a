from conftest import skus
from pyspark.sql import functions as F

from vitrine.functions import predicates as P
from vitrine.functions.text import number_text
from vitrine.operators import catalog as C
from vitrine.operators import corpus


def test_inventory_on_the_shop(shop):
    assert skus(C.check_inventory(shop, size="M", color="black")) == ["SK-002"]
    assert len(skus(C.check_inventory(shop))) == 8
    assert skus(C.check_inventory(shop, color="WHITE")) == ["SK-001"]
    assert skus(C.check_inventory(shop, occasion="wed", max_price=79.9)) == ["SK-004"]
    assert skus(C.check_inventory(shop, sku="SK-003", category="kurta")) == ["SK-003"]
    # the size is listed although it is out of stock
    assert "SK-002" in skus(C.check_inventory(shop, size="L"))


def test_inventory_edge_rows(odd_shop):
    assert skus(C.check_inventory(odd_shop)) == ["d", "e", "e"]
    assert skus(C.check_inventory(odd_shop, size="", color="", sku="", category="", occasion="")) == ["d", "e", "e"]
    assert skus(C.check_inventory(odd_shop, max_price=0)) == ["e"]
    assert skus(C.check_inventory(odd_shop, max_price=10.0)) == ["d", "e"]
    assert skus(C.check_inventory(odd_shop, color="%")) == ["e"]
    assert skus(C.check_inventory(odd_shop, color="white", occasion="e_N")) == ["d"]
    assert skus(C.check_inventory(odd_shop, size="M")) == ["d"]
    assert skus(C.check_inventory(odd_shop, category="top")) == ["d"]


def test_nested_predicates_are_never_null(odd_shop):
    predicates = [
        P.has_size("M"), P.has_color("white"), P.has_occasion("x"), P.in_stock(), P.out_in_some_sizes()
    ]
    values = odd_shop.select(*[p.alias(f"p{i}") for i, p in enumerate(predicates)]).collect()
    assert all(v is not None for row in values for v in row)


def test_lookup_takes_the_first_in_file_order(spark, odd_shop):
    assert [r.name for r in C.product_by_sku(odd_shop, "e").collect()] == ["free"]
    assert C.product_by_sku(odd_shop, "zz").count() == 0
    requests = spark.createDataFrame([("e",), ("e",), ("a",), ("zz",)], "sku string")
    found = C.products_by_sku(requests, odd_shop)
    assert sorted((r.sku, r.name) for r in found.collect()) == [("a", "100%_cotton"), ("e", "free")]


def test_low_stock(shop, odd_shop):
    low = {r.sku: r.low_stock_sizes for r in C.low_stock(shop, 3).collect()}
    assert low == {
        "SK-001": ["XL"],
        "SK-002": ["M", "L"],
        "SK-004": ["M", "XL", "XXL"],
        "SK-006": ["S"],
        "SK-007": ["S", "M", "L"],
        "SK-008": ["XXL"],
    }
    assert skus(C.low_stock(odd_shop, 0)) == ["c", "d", "e"]


def test_stock_and_price_reports(shop):
    assert skus(C.partial_stock(shop)) == ["SK-002", "SK-006"]
    assert [(r.sku, r.price_eur) for r in C.top_price(shop).collect()] == [("SK-007", 249.0)]
    assert skus(C.occasion_budget(shop, "casual", 55)) == ["SK-001", "SK-003", "SK-006", "SK-008"]
    assert skus(C.keyword_search(shop, ["wool", "warm"])) == ["SK-005"]
    assert skus(C.any_occasion(shop, ["formal", "bridal"])) == ["SK-004", "SK-007"]
    assert skus(C.all_occasions(shop, ["casual", "festive"])) == []
    assert skus(C.all_occasions(shop, ["casual", "everyday", "casual"])) == ["SK-001", "SK-008"]
    assert skus(shop.filter(P.has_size("XXL"))) == ["SK-004", "SK-008"]


def test_size_availability(spark, shop):
    requests = spark.createDataFrame([("SK-006", "S"), ("SK-006", "M"), ("SK-005", "M")], "sku string, size string")
    rows = {(r.sku, r.size): (r.qty, r.status, r.other_sizes) for r in C.size_availability(requests, shop).collect()}
    assert rows == {
        ("SK-006", "S"): (0, "out of stock", ["M", "L"]),
        ("SK-006", "M"): (4, "available", ["L"]),
        ("SK-005", "M"): (None, "not offered", ["one_size"]),
    }


def test_alternatives(spark, shop):
    assert skus(C.alternatives_for(shop, "SK-002", "L")) == ["SK-001", "SK-003", "SK-004", "SK-006", "SK-007", "SK-008"]
    requests = spark.createDataFrame([("SK-002", "L"), ("SK-006", "S"), ("SK-001", "S")], "sku string, size string")
    rows = C.alternatives(requests, shop, 2).orderBy("sku", "place").collect()
    assert [(r.sku, r.place, r.alt_sku) for r in rows] == [
        ("SK-002", 1, "SK-003"),
        ("SK-002", 2, "SK-001"),
        ("SK-006", 1, "SK-001"),
        ("SK-006", 2, "SK-002"),
    ]


def test_rendering(spark, shop, odd_shop):
    texts = {r.sku: r.text for r in corpus.render_products(shop).collect()}
    assert texts["SK-005"] == (
        "SKU: SK-005. Name: Item 5. Category: shawl. Fabric: Wool blend. Colors: maroon, red, gold. Sizes: one_size. "
        "Price: 39.9 EUR. Description: About SK-005. Occasion: winter, festive. Care: wash cold. Stock: one_size: 10"
    )
    assert "Price: 45.0 EUR" in texts["SK-003"]
    assert "Stock: S: 4, M: 2, L: 0" in texts["SK-002"]
    prices = spark.createDataFrame([(12_345_678.5,), (2e7,), (249.0,), (49.9,)], "p double")
    assert [r[0] for r in prices.select(number_text(F.col("p"))).collect()] == ["12345678.5", "20000000.0", "249.0", "49.9"]
    chunk = corpus.product_chunks(shop).filter("id = 'SK-007'").first()
    assert chunk.payload.price_eur == 249.0 and chunk.payload.policy_id is None and chunk.source_type == "product"
    assert chunk.payload.source_type == "product"


def test_filters_do_not_shuffle_and_reach_the_scan(spark, shop, tmp_path):
    path = str(tmp_path / "catalog")
    shop.write.parquet(path)
    found = C.check_inventory(spark.read.parquet(path), category="kurta", max_price=50.0, size="M")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Exchange" not in plan
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(category,kurta)" in pushed and "LessThanOrEqual(price_eur,50.0)" in pushed
