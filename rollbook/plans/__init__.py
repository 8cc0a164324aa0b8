"""All registered queries."""

from rollbook.plans import (  # noqa: F401
    dictionary_queries,
    diff_queries,
    directory_queries,
    document_queries,
    pool_queries,
    profile_queries,
    rank_queries,
    rule_queries,
    source_queries,
    stream_queries,
)
from rollbook.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
