"""The registered queries: name -> callable(spark, sf_dir), and the SQL that states the same result."""

from tessera.queries import code, documents, logs, retrieval, sessions, text

MODULES = (text, retrieval, documents, code, sessions, logs)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark, sf_dir):
    return QUERIES["rank_bm25"](spark, sf_dir)
