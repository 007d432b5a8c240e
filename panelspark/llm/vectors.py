"""Vectors in Arrow batches, and cells of a search: bounded blocks of queries against bounded blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from panelspark.llm.common import few, stash


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles; those shorter than `width` end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def row_classes(rows: np.ndarray) -> np.ndarray:
    """A number for each row of a matrix; equal rows have the same."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    rows = np.ascontiguousarray(rows + 0)  # -0.0 and 0.0 are one
    return np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()


def first_of_copies(ids: np.ndarray, classes: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` least ids of each class, every id once: copies score alike, so no others can be among a query's best `keep`."""
    order = np.lexsort((ids, classes))
    i, c = ids[order], classes[order]
    once = np.ones(len(order), bool)
    once[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
    order, c = order[once], c[once]
    starts = np.ones(len(c), bool)
    starts[1:] = c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(c)), 0))
    return order[np.arange(len(c)) - first < keep]


def leading(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's `k` best: greatest score first, then least id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    starts = np.ones(len(own), bool)
    starts[1:] = own[1:] != own[:-1]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - first < k]


def _renamed(rows: DataFrame) -> DataFrame:
    """The same columns under ids of their own, for sides that come from one table."""
    return rows.select(*[F.col(c).alias(c, metadata={}) for c in rows.columns])


def cells(left: DataFrame, right: DataFrame, pairs: DataFrame, left_rows: int, right_rows: int) -> PandasCogroupedOps:
    """Blocks of `left` (id, v, g, ...) beside blocks of `right` (id, v, h, ...) for each (g, h) in `pairs`.

    Blocks hold about `left_rows` and `right_rows` rows, whatever the size of a
    group; a row goes to every block of the other side that its group is paired
    with, equal rows to the same.
    """
    nl, nr = left.groupBy("g").agg(F.count(F.lit(1)).alias("nl")), right.groupBy("h").agg(F.count(F.lit(1)).alias("nr"))
    sizes = pairs.join(nl, "g").join(nr, "h").select("g", "h", F.ceil(F.col("nl") / left_rows).alias("lp"), F.ceil(F.col("nr") / right_rows).alias("rp"))
    plan = few(stash(sizes, "cells"))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n))
    a = left.join(plan, "g").withColumn("x", part("lp")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rp") - 1))).drop("lp", "rp")
    b = right.join(plan, "h").withColumn("y", part("rp")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lp") - 1))).drop("lp", "rp")
    keys = ["g", "h", "x", "y"]
    return _renamed(a).groupBy(*keys).cogroup(_renamed(b).groupBy(*keys))
