"""Registered queries: ``name -> f(spark, sf_dir)`` and ``name -> SQL`` over the same tables."""

from vitrine.plans import catalog_plans, corpus_plans, dialogue_plans, evaluation_plans, retrieval_plans

_MODULES = (catalog_plans, corpus_plans, retrieval_plans, dialogue_plans, evaluation_plans)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
