"""Small files in the folders that Spark reads, and numbered versions of them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

_DIGITS = 20
_SUFFIX = ".json"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order; none where there is no folder."""
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The committed versions in a folder, oldest first."""
    return [n for n in names(spark, path) if n.endswith(_SUFFIX) and n[: -len(_SUFFIX)].isdigit()]


def commit_text(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """Makes a version, whole or not at all; False, and nothing changes, if it is there already.

    The text is written beside its place and renamed to it, which a reader sees at once
    and which one of several writers wins.
    """
    fs, target = _fs(spark, f"{path}/{version:0{_DIGITS}d}{_SUFFIX}")
    if fs.exists(target):
        return False
    staged = f"{path}/.{uuid.uuid4().hex}.tmp"
    write_text(spark, staged, text)
    # rename() of a FileContext fails where its target exists, unlike that of some file systems.
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), target, options)
    except Exception:
        remove(spark, staged)
        if fs.exists(target):
            return False
        raise
    return True


def age(spark: SparkSession, path: str, now: float) -> float:
    """Seconds since a file or folder was changed."""
    fs, target = _fs(spark, path)
    return now - fs.getFileStatus(target).getModificationTime() / 1000


def bare(path: str) -> str:
    """A path without the slashes that only spell its scheme."""
    return re.sub(r"^file:/+", "/", path)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder, making the folders above its new place; an error where something is there."""
    fs, target = _fs(spark, to)
    if fs.exists(target):
        raise FileExistsError(to)
    fs.mkdirs(target.getParent())
    if not fs.rename(_fs(spark, path)[1], target):
        raise OSError(f"{path} could not be moved to {to}")
