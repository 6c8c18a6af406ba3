"""Shared registry state: one Spark plan and one DuckDB oracle statement per SURVEY key.

Every query reads the driver tables (through the stand-in views) or data Spark
derives from them, over whole tables.  Parameters are the reference defaults
(``n=10000`` rows per task, ``PPC=5``, ``SPC=4000``, seed 42) unless a key
needs something else to exercise its operator.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from claimforge.sources.standins import TaskViews

SEED = 42
N = 10000
PPC = 5
SPC = 4000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def V(spark, root) -> TaskViews:
    return TaskViews(spark, root)
