"""Session helpers: table access and cutting lineage through a written table.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor never
loses them.  Only a local session without that setting gets a folder of its
own; on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list = []


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="inkloom-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session is gone; the folder belongs to its user then
        pass


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this evaluates the plan once.  The table stays
    until the session ends, or until ``drop_cut``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(lambda: [_remove(s, p) for s, p in _written])
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._inkloom_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``cut``; it can't be read any more."""
    path = getattr(df, "_inkloom_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]
