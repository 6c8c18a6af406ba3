"""Table sources.

``source(spark, root, name)`` is the single entry point for a named table (a
"split" of a task is a folder or a partition value).  Parquet is read lazily;
Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(root: str, name: str) -> str:
    """Folder of a table (any store that Spark reads, so it is not probed)."""
    return f"{root.rstrip('/')}/{name}.parquet"


def source(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read one named table below ``root`` (parquet by default, any Spark format otherwise)."""
    reader = spark.read.format(fmt)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(table_path(root, name))


class SchemaError(ValueError):
    """A table lacks a declared column, or has it with another type."""


#: Declared columns of the task tables that come as files, and the names of their class labels.
SCHEMAS: dict[str, StructType] = {}
CLASS_LABELS: dict[str, dict[str, list[str]]] = {}


def declare(name: str, schema: str | StructType, class_labels: dict[str, list[str]] | None = None) -> None:
    """Register the columns that ``load_splits`` checks a table for (nested structs are checked by field), and the
    names of integer class labels."""
    SCHEMAS[name] = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    CLASS_LABELS[name] = dict(class_labels or {})


def check_schema(found: DataType, wanted: DataType, at: str = "") -> None:
    """Raise ``SchemaError`` unless ``found`` has all that ``wanted`` declares (more columns are fine)."""
    if isinstance(wanted, StructType):
        if not isinstance(found, StructType):
            raise SchemaError(f"{at or 'table'}: {found.simpleString()} where a struct is declared")
        have = {f.name: f.dataType for f in found}
        for f in wanted:
            path = f"{at}.{f.name}".lstrip(".")
            if f.name not in have:
                raise SchemaError(f"{path}: missing")
            check_schema(have[f.name], f.dataType, path)
    elif isinstance(wanted, ArrayType) and isinstance(found, ArrayType):
        check_schema(found.elementType, wanted.elementType, f"{at}[]")
    elif found.simpleString() != wanted.simpleString():
        raise SchemaError(f"{at}: {found.simpleString()} where {wanted.simpleString()} is declared")


def load_splits(spark: SparkSession, root: str, name: str, splits, column: str = "split", fmt: str = "parquet") -> DataFrame:
    """A1: some splits of a table that stores them as partition values ``column=...``, with only the declared columns.

    The schema is that of the files' footers, checked before any row is read; splits are pruned by folder.  A split
    that the table does not have raises ``ValueError``.
    """
    splits = [splits] if isinstance(splits, str) else list(splits)
    table = source(spark, root, name, fmt)
    wanted = SCHEMAS.get(name)
    if wanted is not None:
        check_schema(StructType([f for f in table.schema if f.name != column]), wanted)
        table = table.select(*wanted.names, column)
    there = {r[0] for r in table.select(column).distinct().collect()}  # of the partition values
    if missing := [s for s in splits if s not in there]:
        raise ValueError(f"{name}: no split {', '.join(missing)}")
    return table.filter(F.col(column).isin(splits))


def with_class_names(df: DataFrame, name: str, suffix: str = "_name") -> DataFrame:
    """The declared names beside integer class labels; null for a label outside them (no gold label)."""
    for column, names in CLASS_LABELS.get(name, {}).items():
        listed = F.array(*[F.lit(n) for n in names])
        df = df.withColumn(column + suffix, F.when(F.col(column) >= 0, F.get(listed, F.col(column).cast("int"))))
    return df


def split_of(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Select one split of a table that stores splits as a (partition) column."""
    return df.filter(F.col(column) == F.lit(split))
