"""Reshaping, dedup, joins, windows and statistics over result tables (H1-H14, E-rows).

Everything is a built-in aggregate, window or join.  Series operators (smoothing)
partition by the series key, so each task holds one short series; nothing is
collected except the final formatted rows of a report.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import format_1f, parse_percent

# ---- fixed orderings and code tables (values the reports rely on) ----------------------------------
SHOT_ORDER = ["0", "32", "200", "500", "1000", "full"]
SHOT_RECODE = {"full": "full/3000"}
SPC_LABELS = {1000: "1k", 2000: "2k", 3000: "3k", 4000: "4k", 5000: "5k", 10000: "10k", 20000: "20k", 40000: "40k", 50000: "50k"}


def recode(c, mapping: dict) -> Column:
    """Value mapping with unlisted values kept."""
    col = c if isinstance(c, Column) else F.col(c)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col], col.cast("string"))


def shot_order(c="shot") -> Column:
    col = c if isinstance(c, Column) else F.col(c)
    m = F.create_map(*[x for i, s in enumerate(SHOT_ORDER) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(m[col], F.lit(len(SHOT_ORDER)))


def pivot_mean(df: DataFrame, index, column: str, values: list[str], value: str) -> DataFrame:
    """``pivot_table(value, index, column)`` (mean) with a fixed column order."""
    return df.groupBy(*index).pivot(column, values).agg(F.avg(value))


def melt(df: DataFrame, ids, value_cols, var_name="shot", value_name="accuracy") -> DataFrame:
    """H2: wide -> long."""
    return df.unpivot(list(ids), list(value_cols), var_name, value_name)


def dedup_first(df: DataFrame, keys, order) -> DataFrame:
    """H3: keep the first row of each key in an explicit order (ascending ``order`` columns).

    An aggregate, not a window: ``min_by`` combines map-side, so a key holding a third of
    all rows is reduced in every partition before the shuffle instead of in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [o if isinstance(o, str) else o for o in order]
    ordkey = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order_cols])
    row = F.min_by(F.struct(*[F.col(c) for c in rest]), ordkey).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def dedup_none(df: DataFrame, keys) -> DataFrame:
    """H4: drop every member of a duplicated key (NULLs compare equal); an aggregate with map-side combine."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), F.any_value(F.struct(*[F.col(c) for c in rest])).alias("_row"))
    return agg.filter("_cnt = 1").select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def baseline_delta(results: DataFrame, baseline: DataFrame, on=("shot", "dataset"), value="Mean", base_value="accuracy") -> DataFrame:
    """H7: subtract the baseline accuracy of the same (shot, dataset); first baseline row per key.

    Results without a baseline stay, with a NULL delta.
    """
    on = list(on)
    ranked = baseline.withColumn("_nullfirst", F.col(base_value).isNull())
    b = dedup_first(ranked, on, ["_nullfirst", base_value]).select(*on, F.col(base_value).alias("_base"))
    return results.join(b, on, "left").withColumn("delta", F.col(value) - F.col("_base")).drop("_base")


# ---- H8: Savitzky-Golay smoothing -------------------------------------------------------------------


@lru_cache(maxsize=None)
def hat_matrix(window: int, order: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Least-squares polynomial fit evaluated at the window positions (rows: output position), exactly: one
    denominator and integer numerators."""
    x = [[Fraction(k) ** p for p in range(order + 1)] for k in range(window)]
    size = order + 1
    # X (X'X)^-1 X': the columns of (X'X)^-1 X' by elimination
    rows = [[sum(r[a] * r[b] for r in x) for b in range(size)] + [x[k][a] for k in range(window)] for a in range(size)]
    for a in range(size):
        at = next(b for b in range(a, size) if rows[b][a])
        rows[a], rows[at] = rows[at], rows[a]
        rows[a] = [v / rows[a][a] for v in rows[a]]
        for b in range(size):
            if b != a and rows[b][a]:
                rows[b] = [v - rows[b][a] * w for v, w in zip(rows[b], rows[a])]
    fit = [[sum(x[i][a] * rows[a][size + k] for a in range(size)) for k in range(window)] for i in range(window)]
    below = math.lcm(*(v.denominator for row in fit for v in row))
    return below, tuple(tuple(int(v * below) for v in row) for row in fit)


#: Values enter the smoothing as whole numbers of 10**-SCALE.
SCALE = 9


def savgol(df: DataFrame, keys, order_col: str, value: str, window: int = 7, polyorder: int = 5, out: str | None = None, places: int | None = None) -> DataFrame:
    """H8: smoothing along ``order_col`` per ``keys``; edges from the polynomial fit of the
    first / last window (interp mode).  Series shorter than the window give NULL.

    Sums are of whole numbers (the value at 9 places times integer weights), so the result does not depend on
    the order of terms.  With ``places`` it is rounded there, halves away from zero; else divided as a double.
    """
    out = out or f"{value}_smoothed"
    keys = list(keys)
    half = window // 2
    below, weights = hat_matrix(window, polyorder)
    w = Window.partitionBy(*keys).orderBy(order_col)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    frame = w.rowsBetween(-(window - 1), window - 1)
    whole = F.round(F.col(value).cast("double") * F.lit(float(10**SCALE))).cast("decimal(20,0)")
    x = x.withColumn("_ys", F.collect_list(whole).over(frame))
    start = F.greatest(F.col("_i") - (window - 1), F.lit(0))
    base = F.least(F.greatest(F.col("_i") - half, F.lit(0)), F.col("_n") - window)
    flat = F.array(*[F.lit(v).cast("decimal(18,0)") for row in weights for v in row])
    r = F.col("_i") - base
    terms = [
        F.try_element_at(flat, (r * window + k + 1).cast("int")) * F.try_element_at(F.col("_ys"), (base + k - start + 1).cast("int"))
        for k in range(window)
    ]
    x = x.withColumn("_sum", F.when(F.col("_n") >= window, reduce(lambda a, b: a + b, terms)).cast("decimal(38,0)"))
    if places is None:
        res = F.col("_sum").cast("double") / F.lit(float(below)) / F.lit(float(10**SCALE))
    else:
        unit = below * 10 ** (SCALE - places)
        size = F.expr(f"cast((2 * abs(_sum) + {unit}BD) div {2 * unit}BD as double)")
        res = F.when(F.col("_sum") < 0, -size).otherwise(size) / F.lit(float(10**places))
    return x.withColumn(out, res).drop("_i", "_n", "_ys", "_sum")


def confidence_band(df: DataFrame, center: str, spread: str = "std") -> DataFrame:
    """Center +- spread."""
    return df.withColumn("upper", F.col(center) + F.col(spread)).withColumn("lower", F.col(center) - F.col(spread))


# ---- H9-H12: statistics across datasets / shots ------------------------------------------------------


def shot_correlation(results: DataFrame, shots=("0", "32", "200", "500", "full"), by=("SPC", "dataset"), value="Mean") -> DataFrame:
    """H9: Pearson correlation between shot settings over (SPC, dataset) cells, pairwise complete."""
    by = list(by)
    cells = results.filter(F.col("shot").isin(list(shots))).groupBy(*by, "shot").agg(F.avg(value).alias("v"))
    a = cells.select(*by, F.col("shot").alias("shot_a"), F.col("v").alias("va"))
    b = cells.select(*by, F.col("shot").alias("shot_b"), F.col("v").alias("vb"))
    pairs = a.join(b, by)
    return pairs.groupBy("shot_a", "shot_b").agg(
        F.when(
            (F.count(F.lit(1)) >= 2) & (F.stddev_pop("va") > 0) & (F.stddev_pop("vb") > 0), F.corr("va", "vb")
        ).alias("corr"),
        F.count(F.lit(1)).alias("n_cells"),
    )


def gmean(c) -> Column:
    """Geometric mean (0 if any value is 0; NULL if any is NULL or negative)."""
    col = c if isinstance(c, Column) else F.col(c)
    return (
        F.when(F.count(col) < F.count(F.lit(1)), F.lit(None).cast("double"))
        .when(F.min(col) < 0, F.lit(None).cast("double"))
        .when(F.min(col) == 0, F.lit(0.0))
        .otherwise(F.exp(F.avg(F.log(F.when(col > 0, col)))))
    )


def rms(c) -> Column:
    """Root mean square with the pooled-std NULL rule."""
    col = c if isinstance(c, Column) else F.col(c)
    return F.when(F.count(col) < F.count(F.lit(1)), F.lit(None).cast("double")).otherwise(F.sqrt(F.avg(col * col)))


def row_mean(cols) -> Column:
    """Mean across columns of a row, skipping NULLs."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def latex_rows(df: DataFrame, label_cols, value_cols, sep: str = " & ") -> DataFrame:
    """One formatted line per row: labels as text, values as ``{:.1f}`` (thousands separator)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in label_cols]
    parts += [F.coalesce(format_1f(F.col(c)), F.lit("nan")) for c in value_cols]
    return df.withColumn("line", F.concat_ws(sep, *parts))


def format_cell(mean="Mean", std="std") -> Column:
    """``mean$_{(std)}$`` with one decimal and thousands separators."""
    return F.concat(
        F.coalesce(format_1f(F.col(mean)), F.lit("nan")), F.lit("$_{("), F.coalesce(format_1f(F.col(std)), F.lit("nan")), F.lit(")}$")
    )


__all__ = [
    "SHOT_ORDER", "SHOT_RECODE", "SPC_LABELS", "recode", "shot_order", "pivot_mean", "melt", "dedup_first", "dedup_none",
    "baseline_delta", "hat_matrix", "savgol", "confidence_band", "shot_correlation", "gmean", "rms", "row_mean",
    "latex_rows", "format_cell", "parse_percent",
]
