"""The functions that statements know by name, and how Spark computes them."""

from .curated import AGGREGATES, CURATED, aggregate_column, scalar_column, spark_aggregate  # noqa: F401
