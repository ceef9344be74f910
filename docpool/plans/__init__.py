"""All queries of the core by name, with their SQL."""

from docpool.plans import lifecycle, retrieval, snapshots

QUERIES = {**retrieval.QUERIES, **lifecycle.QUERIES, **snapshots.QUERIES}
ORACLE = {**retrieval.ORACLE, **lifecycle.ORACLE, **snapshots.ORACLE}
