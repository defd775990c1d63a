"""Operators of a training-data pipeline: extraction, deduplication, filtering and token output.

Every operator is a function of DataFrames; the thin registered queries are in
:mod:`vitrine.llm.queries`.  Nothing outside this package imports it, apart from the
guarded import of the query registry.
"""
