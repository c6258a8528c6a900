"""The registered queries of the retrieval engine and their SQL twins."""

from __future__ import annotations

from lectern import registry
from lectern.plans import answer_queries, block_queries, evidence_queries, index_queries, rule_queries, search_queries, text_queries  # noqa: F401  (they register their queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
