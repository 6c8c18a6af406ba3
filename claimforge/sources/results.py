"""Result, speed and baseline files: sinks (A5, A6) and directory scans (A2, A3, A4).

Result tables are written as CSV datasets (one folder per experiment, many part
files, written in parallel).  In a directory each file's header names its fields, so files may
differ in column order, lack columns or carry more (an unnamed index column, say), and every
value is taken by name in one scan of all files.  Result files are read as CSV records, whose quoted
values may hold commas, quotes and line breaks; speed files, of numbers, as lines.  ``file`` (from
``_metadata``) identifies the experiment a row came from, which gives duplicate keys a defined order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ["model", "shot", "SPC", "PPC", "excluded", "dataset", "Mean", "std", "speed"]
RESULT_SCHEMA = (
    "model string, shot string, SPC int, PPC int, excluded string, dataset string, Mean double, std double, speed double"
)


def write_results(df: DataFrame, path: str, mode: str = "overwrite", variant: str = "plain", fmt: str = "csv", partition_by=()) -> str:
    """A5: write an aggregated result table (CSV with header and NULL as empty, or any Spark format).

    ``variant`` says what the runs were done on (``plain``, ``shuffled``): results of one key but
    different variants stay apart.  ``partition_by`` lays out folders, e.g. ``("model", "SPC")``.
    """
    out = df if "variant" in df.columns else df.withColumn("variant", F.lit(variant))
    writer = out.select(*RESULT_COLUMNS, "variant").write.mode(mode).partitionBy(*partition_by)
    (writer.options(header=True, escape='"') if fmt == "csv" else writer).format(fmt).save(path)
    return path


_FIELDS = """split({0}, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)"""
_BARE = """transform({0}, f -> replace(replace(regexp_replace(trim(f), '^"(.*)"$', '$1'), '\\\\"', '"'), '""', '"'))"""


def _named_lines(spark: SparkSession, path: str, is_header, **options) -> DataFrame:
    """``file, fields``: each data line of the files below ``path`` as a map from its file's column names
    (an unnamed column is ``_c0``, ``_c1``, ...).  Values must not hold line breaks."""
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    lines = reader.text(path).select(
        F.expr(_BARE.format(_FIELDS.format("value"))).alias("v"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
    ).filter("size(v) > 1 OR v[0] <> ''")
    return _by_name(lines, is_header)


def _named_records(spark: SparkSession, path: str, is_header, **options) -> DataFrame:
    """``file, fields`` as of ``_named_lines``, of CSV records (a doubled quote stands for one)."""
    reader = spark.read.options(**options)
    width = reader.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1  # no record has more fields
    reader = reader.options(header=False, multiLine=True, quote='"', escape='"')
    records = reader.schema(", ".join(f"_c{i} string" for i in range(width))).csv(path)
    fields = F.array(*[F.coalesce(F.trim(f"_c{i}"), F.lit("")) for i in range(width)])
    return _by_name(records.select(fields.alias("v"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")), is_header)


def _by_name(lines: DataFrame, is_header) -> DataFrame:
    lines = lines.withColumn("head", is_header(F.col("v")))
    names = F.transform("v", lambda c, i: F.when(c == "", F.concat(F.lit("_c"), i.cast("string"))).otherwise(c))
    heads = lines.filter("head").groupBy("path").agg(F.first(names).alias("names"))  # one row per file
    rows = lines.filter("NOT head").join(heads, "path")
    fields = F.transform("names", lambda c, i: F.get("v", i))
    return rows.select("file", F.map_from_arrays("names", fields).alias("fields"))


def _value(name: str, dtype: str):
    raw = F.try_element_at("fields", F.lit(name))
    return F.when(~raw.isin("", "None", "nan", "NaN"), raw).try_cast(dtype).alias(name)


def scan_results_dir(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """A2: every result file below ``root``, columns by name, plus the file name.

    ``None`` and empty fields read as NULL (the modelled files use both); a column that a file
    lacks is NULL in its rows.
    """
    is_header = lambda v: F.array_contains(v, "dataset") & F.array_contains(v, "Mean")
    rows = _named_records(spark, root, is_header, recursiveFileLookup=True, pathGlobFilter=pattern)
    columns = [c.split() for c in RESULT_SCHEMA.split(", ")]
    variant = F.coalesce(_value("variant", "string"), F.lit("plain")).alias("variant")
    return rows.select(*[_value(c, t) for c, t in columns], variant, "file")


def write_speed_wide(speeds_long: DataFrame, path: str, datasets: list[str], mode: str = "overwrite") -> str:
    """Model rows x dataset columns (mean examples/s), written as CSV."""
    wide = speeds_long.groupBy("model").pivot("dataset", datasets).agg(F.avg("examples_per_s"))
    wide.write.mode(mode).option("header", True).csv(path)
    return path


def scan_speed_files(spark: SparkSession, glob_path: str) -> DataFrame:
    """A3: union of speed files (path glob, e.g. ``.../*speeds*``), columns by name.

    The model is in a column of that name or in the unnamed first one; the others are the
    data sets of any file, each NULL where a file lacks it.
    """
    number = lambda x: x.try_cast("double").isNotNull() | (x == "")
    is_header = lambda v: ~F.exists(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), number)
    rows = _named_lines(spark, glob_path, is_header)
    names = [r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().orderBy("col").collect()]  # column names
    sets = [n for n in names if n != "model" and not n.startswith("_c")]
    model = F.coalesce(F.try_element_at("fields", F.lit("model")), F.try_element_at("fields", F.lit("_c0")))
    return rows.select(model.alias("model"), *[_value(n, "double") for n in sets])


def write_wide_baseline(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_wide_baseline(spark: SparkSession, path: str, full_col: str = "full_shot", renamed: str = "full_3000_shot") -> DataFrame:
    """A4: wide percent table; the full-data column is renamed."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumnRenamed(full_col, renamed)
