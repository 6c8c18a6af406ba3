"""Aggregation of repeated runs (G1-G9) and the result-table helpers around it.

Null rules follow the modelled code, not SQL defaults: a sample std over one run
is missing; a pooled std is missing as soon as one input std is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_KEYS = ["model", "shot", "SPC", "PPC", "excluded", "dataset"]

MEAN_SCALE = 9


def exact_mean(c, scale: int = MEAN_SCALE) -> Column:
    """Mean from an exact decimal sum: the same bits under any partitioning or task order.

    A floating-point ``avg`` depends on the order partial sums are combined in, so a
    report could change in its last digit when the cluster re-plans.  Values are summed
    as ``decimal(38, scale)`` and divided once.
    """
    col = c if isinstance(c, Column) else F.col(c)
    n = F.count(col)
    return F.when(n > 0, F.sum(col.cast(f"decimal(38,{scale})")).cast("double") / n)


def run_summary(runs: DataFrame, keys=("model_no",) + tuple(RESULT_KEYS)) -> DataFrame:
    """G1: mean accuracy, sample std (NULL for one run) and mean examples/s per key."""
    keys = list(keys)
    return runs.groupBy(*keys).agg(
        exact_mean("accuracy").alias("Mean"),
        F.stddev_samp("accuracy").alias("std"),
        exact_mean(F.col("n_examples") / F.col("seconds")).alias("speed"),
    )


def pooled_std(col: str = "std") -> Column:
    """``sqrt(mean(std^2))``; NULL when any std of the group is NULL."""
    c = F.col(col)
    return F.when(F.count(c) < F.count(F.lit(1)), F.lit(None).cast("double")).otherwise(F.sqrt(F.avg(c * c)))


def pooled_summary(summary: DataFrame, keys=tuple(RESULT_KEYS)) -> DataFrame:
    """Over models of one configuration: mean of means, pooled std, mean speed - one aggregate."""
    return summary.groupBy(*keys).agg(
        exact_mean("Mean").alias("Mean"), pooled_std("std").alias("std"), exact_mean("speed").alias("speed")
    )


def macro_average(results: DataFrame, keys, col: str = "Mean") -> DataFrame:
    """Mean over datasets."""
    return results.groupBy(*keys).agg(exact_mean(col).alias(f"macro_{col}"))


def group_first_std(results: DataFrame, how: str = "max", by=("dataset",), order=("SPC", "model", "excluded")) -> DataFrame:
    """Per dataset max (or mean) of Mean and the first non-null std in ``order``."""
    by = list(by)
    ordkey = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "excluded" else F.col(c) for c in order])
    agg_mean = F.max("Mean") if how == "max" else exact_mean("Mean")
    first_std = F.min_by(F.col("std"), F.when(F.col("std").isNotNull(), ordkey))
    return results.groupBy(*by).agg(agg_mean.alias("Mean"), first_std.alias("std"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, sorted."""
    return df.select(col).distinct().orderBy(col)
