"""All queries of the library's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import accuracy, authority, claims, decisions, governance, policies, qualification, records, scalars, streams, tpch, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "accuracy_summary"

for _module in (accuracy, authority, claims, decisions, governance, policies, qualification, records, scalars, streams, tpch, windows):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
