"""All registered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import probes, relational

FLAGSHIP = "segment_docs"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | probes.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | probes.ORACLES
