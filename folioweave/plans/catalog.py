"""All core queries and their SQL, by name."""

from __future__ import annotations

from folioweave.plans import registry


def _load() -> None:
    from folioweave.plans import index_queries, pipeline_queries, retrieval_queries, text_queries  # noqa: F401  importing registers them


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
