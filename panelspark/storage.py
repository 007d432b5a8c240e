"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and driver and executors are one process, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="panelspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/panelspark/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which ends its lineage.

    The files stay while the application may read them; they go with it, or before
    with `discard` or `clear`.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Cells (rows by columns) up to which `settled` keeps a table in the driver.
SMALL_CELLS = 1_000_000


def settled(df: DataFrame, label: str, rows: int) -> DataFrame:
    """`df`, of `rows` rows at most, computed once: a local table if that is few, else `stash`ed. For steps of an iteration."""
    if rows * len(df.columns) <= SMALL_CELLS:
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    return stash(df, label)


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that no plan still to run reads; other tables are left alone."""
    for table in tables:
        if (path := _paths.pop(table, None)) is not None:
            fs, target = _path(table.sparkSession, path)
            fs.delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables: for after its results are written."""
    fs, target = _path(spark, _folder(spark))
    fs.delete(target, True)
