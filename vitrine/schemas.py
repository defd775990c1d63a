"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

_S = T.StringType()
_LIST = T.ArrayType(T.StringType())

CATALOG = T.StructType(
    [
        T.StructField("sku", _S),
        T.StructField("name", _S),
        T.StructField("category", _S),
        T.StructField("fabric", _S),
        T.StructField("colors", _LIST),
        T.StructField("sizes", _LIST),
        T.StructField("price_eur", T.DoubleType()),
        T.StructField("stock", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("care_instructions", _S),
        T.StructField("occasion", _LIST),
        T.StructField("short_description", _S),
    ]
)

DOCUMENT = T.StructType([T.StructField("id", _S), T.StructField("text", _S)])

# one payload type for product and document chunks; the fields of the other kind are null
PAYLOAD = T.StructType(
    [
        T.StructField("sku", _S),
        T.StructField("name", _S),
        T.StructField("category", _S),
        T.StructField("fabric", _S),
        T.StructField("colors", _LIST),
        T.StructField("sizes", _LIST),
        T.StructField("price_eur", T.DoubleType()),
        T.StructField("occasion", _LIST),
        T.StructField("policy_id", _S),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("source_type", _S),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("source_type", _S),
        T.StructField("text", _S),
        T.StructField("payload", PAYLOAD),
    ]
)

POINT = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("payload", PAYLOAD),
    ]
)

REQUEST = T.StructType([T.StructField("query", _S), T.StructField("session_id", _S)])

GOLD = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("question", _S),
        T.StructField("expected_answer", _S),
        T.StructField("source_type", _S),
        T.StructField("source_ids", _LIST),
        T.StructField("required_facts", _LIST),
        T.StructField("difficulty", _S),
    ]
)

RUBRIC = T.StructType(
    [
        T.StructField("dimension", _S),
        T.StructField("score", T.IntegerType()),
        T.StructField("anchor", _S),
    ]
)
