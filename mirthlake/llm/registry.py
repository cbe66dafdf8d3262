"""All queries of this subpackage, and the SQL of those that SQL can express."""

from . import queries_near, queries_nearest, queries_overlap, queries_personal, queries_residue, queries_sizes, queries_terms

_MODULES = [queries_overlap, queries_near, queries_terms, queries_residue, queries_nearest, queries_sizes, queries_personal]


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
