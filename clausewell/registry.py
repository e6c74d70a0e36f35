"""All registered queries of the retrieval and clause engine, and their SQL."""

from clausewell import index_queries, intake_queries, queries, record_queries, stream_queries, study_queries

MODULES = (queries, study_queries, intake_queries, index_queries, stream_queries, record_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES"]
