"""Extension points: batch and group hooks for user code (J1-J3) and the length filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import token_count


def flat_map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``fn`` turns a batch of rows into any number of rows (one row can give many, or none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], name: str, dtype: str) -> DataFrame:
    """A new column computed from batches of rows; ``fn`` returns one value per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: fn(b)})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` {dtype}")


def filter_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which ``fn`` (a boolean per row of a batch) says yes."""
    return flat_map_batches(df, lambda b: b[fn(b)], df.schema)


def aggregate_groups(df: DataFrame, keys, fn: Callable[[pd.Series], float], column: str, name: str) -> DataFrame:
    """A user's aggregate of one numeric column per group.

    The values of a group meet in one task, as the function needs them together; use built-in
    aggregates for groups that are not small.
    """
    def run(v: pd.Series) -> float:
        return float(fn(v))

    agg = F.pandas_udf(run, "double")
    return df.groupBy(*keys).agg(agg(F.col(column)).alias(name))


def max_token_filter(df: DataFrame, column: str, limit: int, count: Callable[[str], Column] = token_count, name: str = "n_tokens") -> DataFrame:
    """Rows whose text has fewer than ``limit`` tokens; ``count`` is the counter."""
    return df.withColumn(name, count(column).cast("bigint")).filter(F.col(name) < limit)
