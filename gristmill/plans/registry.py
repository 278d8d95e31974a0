"""Registered queries over the given tables and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans import classification, files, preparation, profiles, querying

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for part in (querying, preparation, classification, profiles, files):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
