"""Everything that is registered; importing the modules fills the registry."""

from paperloom.plans import (  # noqa: F401
    curation_queries,
    document_queries,
    evaluation_queries,
    ingest_queries,
    limiter_queries,
    listing_queries,
    search_queries,
    source_queries,
)
from paperloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
