"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.storage import discard, stash

__all__ = ["ASCII_SPACE", "BROADCAST_ROWS", "discard", "few", "free_names", "packed", "partitions", "read_table", "sliced", "stash", "text_key"]

#: The six ASCII white-space code points of the `[\x20\x09-\x0D]` class.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of ids or keys (8 to 16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 2_000_000
#: Rows of ids, keys and counts in a file of an intermediate table.
ROWS_A_FILE = 50_000
#: Texts that a Python worker takes from an Arrow batch at once.
BATCH_ROWS = 500


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, the measure for salts and shards."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A 128-bit content key of a text (null: empty): equal texts, equal keys."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def few(rows: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """`rows`, to be broadcast if there are `bound` at most: for tables of a key or two that are cheap to count."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def packed(rows: DataFrame, most: int) -> DataFrame:
    """A table of a few short columns, of `most` rows at most, in as few files as that asks for.

    Each file that a task writes has a price of its own (on a local file system without native
    calls even a process that the executor forks to set its permissions), and steps of an iteration write many.
    """
    return rows.coalesce(max(1, -(-most // ROWS_A_FILE)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, so that a worker holds few texts at once beside their Arrow form.

    At the end of a task's rows the worker gives back what it has freed: it goes on to tasks of other stages.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not every C library has it
        trim(0)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with as many underscores before them as it takes to clash with none of `columns` in any case."""
    taken = {c.lower() for c in columns}
    lead = ""
    while any((lead + w).lower() in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]
