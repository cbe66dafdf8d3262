"""The named queries over the reference's own operators, with their SQL."""

from .plans import catalogue, evaluation, events, retrieval, reviews, rules

FLAGSHIP = "recommend_batch"
_MODULES = [retrieval, evaluation, events, catalogue, reviews, rules]


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
