"""Registered queries: a Spark callable each and, where one exists, the same result in SQL."""

from catalog.registry import CATALOG
from catalog import (  # noqa: F401  (imported for their registrations)
    cleaning, correlations, distributions, filtering, insight_runs, profiles, projections,
    rankings, scalars, scans, trends,
)

__all__ = ["CATALOG"]
