"""The driver's queries: importing the modules fills the registry."""

from corvane.queries import files, fulltext, fusion, graph, maintenance, messages, search, streaming, vectors  # noqa: F401
from corvane.queries.base import REGISTRY, SQL


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(SQL)
