"""Session helpers.

The library never invents storage locations on a cluster: lineage cuts and
intermediate files go below the shared folder named by ``spark.checkpoint.dir``.
Only a ``local[...]`` session without that setting (tests, laptops) gets a
private temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "claimforge") -> SparkSession:
    """Session with the settings the operators are tuned for (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the session.

    Order: an already set checkpoint dir; the ``spark.checkpoint.dir`` setting;
    a private temp folder, but only for a local master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running claimforge jobs")
        conf = tempfile.mkdtemp(prefix="claimforge-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this session has written below the checkpoint folder (they are needed as long
    as a DataFrame that reads them is)."""
    _delete(spark, os.path.join(ensure_checkpoint_dir(spark), "tables"))


_OPEN: list[list[str]] = []  # tables written in each open scope, see passing_tables
_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()  # where a materialized DataFrame's files are


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable]:
    """Delete the tables that are materialized inside when the block ends.  Gives ``keep(df, name)``, which
    materializes a table that stays; what is used after the block must come from such tables alone."""
    own: list[str] = []
    kept: list[str] = []

    def keep(df, name: str):
        out = materialize(df, name)
        kept.append(_OPEN[-1].pop())
        return out

    _OPEN.append(own)
    try:
        yield keep
    finally:
        _OPEN.remove(own)
        for path in own:
            _delete(spark, path)
        if _OPEN:
            _OPEN[-1].extend(kept)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet below the shared checkpoint folder and reading it back.

    Parquet (unlike an RDD checkpoint) is columnar and compressed, so later passes read only
    the columns they use; recomputation after an executor loss starts from these files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.parquet(path)
    _WRITTEN[out] = path
    return out


def drop_table(df) -> None:
    """Delete the files of a materialized DataFrame that nothing reads any more; any other is left alone."""
    path = _WRITTEN.pop(df, None)
    if path:
        _delete(df.sparkSession, path)
