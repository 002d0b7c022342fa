"""The full set of named queries; importing the modules registers them."""

from __future__ import annotations

from riskcohort.plans import (  # noqa: F401
    assessment_queries, cohort_queries, metric_queries, model_queries, reader_queries,
)
from riskcohort.plans import registry


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()
