"""Registered catalog queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import predicates as P
from vitrine.operators import catalog as C
from vitrine.operators import corpus
from vitrine.plans.views import CATALOG_SQL, FLAT_SQL, SIZES, catalog, flat_catalog, table

STOCKED_SQL = "len(list_filter(qtys, lambda v: v <> 0)) > 0"


def _select(condition: str, extra: str = "") -> str:
    return f"WITH {CATALOG_SQL} SELECT {FLAT_SQL}{extra} FROM catalog WHERE {condition}"


def _requests(spark, sf_dir):
    """One wanted size per part, chosen by its size number."""
    names = F.array(*[F.lit(s) for s in SIZES])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku"), F.element_at(names, F.col("p_size") % 7 + 1).alias("size")
    )


REQUESTS_SQL = """
requests AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku, (['S','M','L','XL','XXL','XS','one_size'])[p_size % 7 + 1] AS size
  FROM part),
pairs AS (SELECT ord, sku, name, price_eur, unnest(sizes) AS size, unnest(qtys) AS qty FROM catalog),
availability AS (
  SELECT r.sku, r.size, p.qty,
         CASE WHEN p.qty IS NULL THEN 'not offered' WHEN p.qty > 0 THEN 'available' ELSE 'out of stock' END AS status
  FROM requests r LEFT JOIN pairs p ON p.sku = r.sku AND p.size = r.size)"""


def catalog_scan(spark, sf_dir):
    return flat_catalog(
        catalog(spark, sf_dir),
        "fabric",
        F.array_join("colors", ",").alias("colors"),
        F.array_join("occasion", ",").alias("occasion"),
        "care_instructions",
        "short_description",
    )


def _filtered(predicate):
    return lambda spark, sf_dir: flat_catalog(catalog(spark, sf_dir).filter(predicate()))


def check_inventory(spark, sf_dir):
    found = C.check_inventory(catalog(spark, sf_dir), size="M", color="RED", max_price=950.0)
    return flat_catalog(found)


def sku_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sku"))
    return flat_catalog(C.products_by_sku(requests, catalog(spark, sf_dir)))


def low_stock(spark, sf_dir):
    low = C.low_stock(catalog(spark, sf_dir), 3)
    return flat_catalog(low, F.array_join("low_stock_sizes", ",").alias("low_stock_sizes"))


def size_availability(spark, sf_dir):
    return C.size_availability(_requests(spark, sf_dir), catalog(spark, sf_dir)).select(
        "sku", "size", F.col("qty").cast("bigint").alias("qty"), "status",
        F.array_join("other_sizes", ",").alias("other_sizes"),
    )


def alternatives(spark, sf_dir):
    found = C.alternatives(_requests(spark, sf_dir), catalog(spark, sf_dir), 3)
    return found.withColumn("place", F.col("place").cast("bigint"))


def render_product(spark, sf_dir):
    return corpus.render_products(catalog(spark, sf_dir))


def product_payload(spark, sf_dir):
    payload = catalog(spark, sf_dir).select(corpus.product_payload().alias("p")).select("p.*")
    return payload.select(
        "sku", "name", "category", "fabric", F.array_join("colors", ",").alias("colors"),
        F.array_join("sizes", ",").alias("sizes"), "price_eur",
        F.array_join("occasion", ",").alias("occasion"), "source_type",
    )


def product_chunks(spark, sf_dir):
    return corpus.product_chunks(catalog(spark, sf_dir)).select(
        "id", "source_type", "text", F.col("payload.category").alias("category")
    )


RENDER_SQL = """
'SKU: ' || sku || '. Name: ' || name || '. Category: ' || category || '. Fabric: ' || fabric
|| '. Colors: ' || array_to_string(colors, ', ') || '. Sizes: ' || coalesce(array_to_string(sizes, ', '), '')
|| '. Price: ' || CAST(price_eur AS VARCHAR) || ' EUR. Description: ' || short_description
|| '. Occasion: ' || array_to_string(occasion, ', ') || '. Care: ' || care_instructions
|| '. Stock: ' || coalesce(stock_text, '')"""

QUERIES = {
    "catalog_scan": catalog_scan,
    "filter_size": _filtered(lambda: P.has_size("XXL")),
    "filter_color": _filtered(lambda: P.has_color("LD")),
    "filter_category": _filtered(lambda: P.in_category("ECONOMY")),
    "filter_price": _filtered(lambda: P.price_up_to(930.5)),
    "filter_occasion": _filtered(lambda: P.has_occasion("brand#1")),
    "filter_in_stock": _filtered(P.in_stock),
    "filter_sku": lambda spark, sf_dir: flat_catalog(C.check_inventory(catalog(spark, sf_dir), sku="7")),
    "check_inventory": check_inventory,
    "sku_lookup": sku_lookup,
    "low_stock": low_stock,
    "top_price": lambda spark, sf_dir: flat_catalog(C.top_price(catalog(spark, sf_dir), 10)),
    "partial_stock": lambda spark, sf_dir: flat_catalog(C.partial_stock(catalog(spark, sf_dir))),
    "occasion_budget": lambda spark, sf_dir: flat_catalog(
        C.occasion_budget(catalog(spark, sf_dir), "small", 960.0)
    ),
    "keyword_search": lambda spark, sf_dir: flat_catalog(
        C.keyword_search(catalog(spark, sf_dir), ["cold", "Brand#7"])
    ),
    "any_occasion": lambda spark, sf_dir: flat_catalog(
        C.any_occasion(catalog(spark, sf_dir), ["ECONOMY", "Brand#3"])
    ),
    "all_occasions": lambda spark, sf_dir: flat_catalog(
        C.all_occasions(catalog(spark, sf_dir), ["ECONOMY", "Brand#3"])
    ),
    "size_availability": size_availability,
    "alternatives": alternatives,
    "render_product": render_product,
    "product_payload": product_payload,
    "product_chunks": product_chunks,
}

ORACLES = {
    "catalog_scan": _select(
        "true",
        ", fabric, array_to_string(colors, ',') AS colors, array_to_string(occasion, ',') AS occasion,"
        " care_instructions, short_description",
    ),
    "filter_size": _select("list_contains(sizes, 'XXL')"),
    "filter_color": _select("len(list_filter(colors, lambda c: contains(lower(c), 'ld'))) > 0"),
    "filter_sku": _select(f"sku = '7' AND {STOCKED_SQL}"),
    "filter_category": _select("category = 'ECONOMY'"),
    "filter_price": _select("price_eur <= 930.5"),
    "filter_occasion": _select("len(list_filter(occasion, lambda o: contains(lower(o), 'brand#1'))) > 0"),
    "filter_in_stock": _select(STOCKED_SQL),
    "check_inventory": _select(
        f"{STOCKED_SQL} AND list_contains(sizes, 'M') AND price_eur <= 950.0"
        " AND len(list_filter(colors, lambda c: contains(lower(c), 'red'))) > 0"
    ),
    "sku_lookup": _select("ord IN (SELECT o_orderkey FROM orders)"),
    "low_stock": f"""WITH {CATALOG_SQL}, low AS (
        SELECT l_partkey, string_agg(size, ',' ORDER BY pos) AS low_stock_sizes
        FROM stock_rows WHERE qty <= 3 GROUP BY l_partkey)
        SELECT {FLAT_SQL}, low_stock_sizes FROM catalog JOIN low ON l_partkey = ord""",
    "top_price": _select("true") + " ORDER BY catalog.price_eur DESC, ord LIMIT 10",
    "partial_stock": _select(
        "len(list_filter(qtys, lambda v: v = 0)) > 0 AND len(list_filter(qtys, lambda v: v > 0)) > 0"
    ),
    "occasion_budget": _select(
        "price_eur <= 960.0 AND len(list_filter(occasion, lambda o: contains(lower(o), 'small'))) > 0"
    ),
    "keyword_search": _select(
        "contains(lower(fabric || ' ' || short_description), 'cold')"
        " OR contains(lower(fabric || ' ' || short_description), 'brand#7')"
    ),
    "any_occasion": _select("category = 'ECONOMY' OR fabric = 'Brand#3'"),
    "all_occasions": _select("category = 'ECONOMY' AND fabric = 'Brand#3'"),
    "size_availability": f"""WITH {CATALOG_SQL}, {REQUESTS_SQL}
        SELECT a.sku, a.size, a.qty, a.status,
               coalesce((SELECT string_agg(s.size, ',' ORDER BY s.pos) FROM stock_rows s
                         WHERE s.l_partkey = CAST(a.sku AS BIGINT) AND s.qty > 0 AND s.size <> a.size), '') AS other_sizes
        FROM availability a""",
    "alternatives": f"""WITH {CATALOG_SQL}, {REQUESTS_SQL}, ranked AS (
        SELECT a.sku, a.size, p.sku AS alt_sku, p.name AS alt_name, p.price_eur AS alt_price,
               row_number() OVER (PARTITION BY a.sku, a.size ORDER BY p.price_eur, p.ord) AS place
        FROM availability a JOIN pairs p ON p.size = a.size AND p.qty > 0 AND p.sku <> a.sku
        WHERE a.status = 'out of stock')
        SELECT sku, size, place, alt_sku, alt_name, alt_price FROM ranked WHERE place <= 3""",
    "render_product": f"WITH {CATALOG_SQL} SELECT sku, {RENDER_SQL} AS text FROM catalog",
    "product_payload": f"""WITH {CATALOG_SQL} SELECT sku, name, category, fabric,
        array_to_string(colors, ',') AS colors, array_to_string(sizes, ',') AS sizes, price_eur,
        array_to_string(occasion, ',') AS occasion, 'product' AS source_type FROM catalog""",
    "product_chunks": f"""WITH {CATALOG_SQL}
        SELECT sku AS id, 'product' AS source_type, {RENDER_SQL} AS text, category FROM catalog""",
}
