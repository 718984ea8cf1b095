"""The queries of the engine's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftaudit.plans import catalog_reconcile, catalog_scalar, catalog_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**catalog_reconcile.QUERIES, **catalog_scalar.QUERIES, **catalog_text.QUERIES}
ORACLES: dict[str, str] = {**catalog_reconcile.ORACLES, **catalog_scalar.ORACLES, **catalog_text.ORACLES}
