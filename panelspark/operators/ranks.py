"""Places in a global order without a window that all rows meet in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.storage import stash

_INDEX_BITS = 33  # of monotonically_increasing_id


def placed(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """`df` with its rows' places 0, 1, ... (long) in the order given; equal rows in any order.

    Rows are dealt by ranges of the order and sorted there; a range's places start
    at the number of rows in the ranges before it, one number a partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stash(dealt.withColumn("__m", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("__m", _INDEX_BITS), F.col("__m").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    before, starts = 0, []
    for r in sorted(numbered.groupBy(part.alias("p")).count().collect(), key=lambda r: r.p):
        starts.append((r.p, before))
        before += r["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __start long"))
    return numbered.withColumn("__p", part).join(table, "__p").select(*df.columns, (F.col("__start") + within).alias(name))
