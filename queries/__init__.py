"""Registered queries over the given tables, with equivalent SQL where SQL can say it."""

from queries import (  # noqa: F401
    claims, enrichment, linkage, lookups, retrieval, sources, tables, texts,
)

MODULES = (tables, texts, lookups, retrieval, enrichment, claims, linkage, sources)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
