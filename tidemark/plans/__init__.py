"""Registered queries. Importing this package fills the catalog."""

from tidemark.plans import (  # noqa: F401
    aggregation,
    checks,
    flows,
    forecasting,
    models,
    profiling,
    reading,
    runs,
)
from tidemark.plans.catalog import CATALOG

__all__ = ["CATALOG"]
