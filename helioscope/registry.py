"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import community_queries as _community_queries  # noqa: F401
from .plans import exploit_queries as _exploit_queries  # noqa: F401
from .plans import incident_queries as incidents
from .plans import panel_queries as _panel_queries  # noqa: F401  (adds its queries to silver.QUERIES)
from .plans import queries as plans
from .plans import reward_queries as _reward_queries  # noqa: F401
from .plans import signal_queries as _signal_queries  # noqa: F401
from .plans import silver_queries as silver


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.QUERIES | incidents.QUERIES | silver.QUERIES


def oracle_sql() -> dict[str, str]:
    return plans.SQL | incidents.SQL | silver.SQL
