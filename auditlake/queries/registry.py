"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.queries import corpus, dashboard, feed, ingest, listing, validation

_MODULES = [dashboard, listing, ingest, validation, corpus, feed]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for module in _MODULES for query in module.QUERIES}
