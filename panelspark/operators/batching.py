"""Greedy batches of ordered rows, without a task that holds a group.

A batch ends where its next row would break a bound, so each row that could start a
batch points to the row that would start the next: the end of its prefix sum. Rows
are cut into chunks of consecutive ones (and the first rows of the chunk after it).
A chunk tells, for each of its first rows, where a chain of batches that starts
there enters the next chunk and how many batches that takes; pointer doubling over
chunks then gives each chunk its own entry, and all chunks number their rows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.quantiles import join_keys
from panelspark.operators.ranks import placed
from panelspark.storage import discard, stash

#: Rows of a chunk at least.
CHUNK = 65_536


def next_starts(sizes: np.ndarray, max_size: float, max_rows: int) -> np.ndarray:
    """For each row the row that starts the next batch if it starts one; the number of rows at the end."""
    total = np.concatenate([np.zeros(1, sizes.dtype), np.cumsum(sizes)])
    at = np.arange(len(sizes))
    fits = np.searchsorted(total, total[:-1] + max_size, side="right") - 1
    return np.minimum(np.maximum(np.minimum(fits, at + max_rows), at + 1), len(sizes))


def _sizes(table: pa.Table) -> np.ndarray:
    return np.nan_to_num(table["__size"].to_numpy(zero_copy_only=False).astype(float))


def batches(rows: DataFrame, order: str, size: str, max_size: float, max_rows: int, group: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `batch` (0, 1, ... in each group): rows in order, a new batch where the next row would break a bound.

    A row too large for any batch has one of its own. Missing sizes count nothing; sizes are
    not negative, and whole numbers add up exactly below 2^53. Null is a group. Rows that tie
    in `order` come in any order.
    """
    chunk = max(chunk, max_rows)
    at = placed(rows, [F.col(group), F.col(order)], "__at")
    first = at.groupBy(group).agg(F.min("__at").alias("__first"))
    numbered = join_keys(at, first, [group]).withColumn("__c", F.floor((F.col("__at") - F.col("__first")) / chunk)).withColumn("__k", (F.col("__at") - F.col("__first")) % chunk)
    numbered = stash(numbered.select(*rows.columns, F.col("__first").alias("__g"), "__c", "__k", F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("__size")), "numbered")
    last = numbered.agg(F.max("__c")).first()[0] or 0
    entries = numbered.select("__g").distinct().select("__g", F.lit(0).cast("long").alias("__c"), F.lit(0).cast("long").alias("__e"), F.lit(0).cast("long").alias("__b"))
    if last:
        entries = _entries(numbered, entries, last, max_size, max_rows, chunk)
    schema = T.StructType([*numbered.schema.fields, T.StructField("__e", T.LongType()), T.StructField("__b", T.LongType()), T.StructField("batch", T.IntegerType())])

    def number(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["__k"].to_numpy(), kind="stable")))
        ahead, sizes = next_starts(_sizes(table), max_size, max_rows), len(table)
        starts = np.zeros(sizes, np.int64)
        i = int(table["__e"][0].as_py())
        while i < sizes:
            starts[i] = 1
            i = int(ahead[i])
        batch = int(table["__b"][0].as_py()) - 1 + np.cumsum(starts)
        return table.append_column("batch", pa.array(batch, pa.int32()))

    return numbered.join(entries, ["__g", "__c"]).select(*numbered.columns, "__e", "__b").groupBy("__g", "__c").applyInArrow(number, schema).select(*rows.columns, "batch")


def _entries(numbered: DataFrame, known: DataFrame, last: int, max_size: float, max_rows: int, chunk: int) -> DataFrame:
    """For each chunk the row (`__e`) that starts its first batch, and that batch's number (`__b`)."""
    narrow = numbered.select("__g", "__c", "__k", "__size")
    ahead = narrow.filter((F.col("__k") < max_rows) & (F.col("__c") > 0)).select("__g", (F.col("__c") - 1).alias("__c"), (F.col("__k") + chunk).alias("__k"), "__size")

    def chains(key: tuple, table: pa.Table) -> pa.Table:
        k = table["__k"].to_numpy()
        order = np.argsort(k, kind="stable")
        own = int((k < chunk).sum())
        to = next_starts(_sizes(table.take(pa.array(order))), max_size, max_rows).tolist()
        leave, count = [0] * own, [1] * own
        for i in range(own - 1, -1, -1):
            if to[i] >= own:
                leave[i] = to[i] - own
            else:
                leave[i], count[i] = leave[to[i]], count[to[i]] + 1
        n = min(max_rows, own)
        fixed = [pa.array([x.as_py()] * n, pa.int64()) for x in key]
        return pa.table([*fixed, pa.array(range(n), pa.int64()), pa.array(leave[:n], pa.int64()), pa.array(count[:n], pa.int64())], names=["__g", "__c", "__e", "__to", "__n"])

    jump = stash(narrow.union(ahead).groupBy("__g", "__c").applyInArrow(chains, "__g long, __c long, __e long, __to long, __n long"), "chains")
    known = stash(known, "entries")
    width = 1
    while width <= last:
        # Entries of the first `width` chunks give those of as many more; two jumps make one twice as wide.
        more = known.join(jump, ["__g", "__c", "__e"]).select("__g", (F.col("__c") + width).alias("__c"), F.col("__to").alias("__e"), (F.col("__b") + F.col("__n")).alias("__b"))
        second = jump.select("__g", (F.col("__c") - width).alias("__c"), F.col("__e").alias("__to"), F.col("__to").alias("__to2"), F.col("__n").alias("__n2"))
        spent = (known, jump)
        known = stash(known.union(more), "entries")
        width *= 2
        if width <= last:
            jump = stash(jump.join(second, ["__g", "__c", "__to"]).select("__g", "__c", "__e", F.col("__to2").alias("__to"), (F.col("__n") + F.col("__n2")).alias("__n")), "chains")
        discard(*spent)
    return known
