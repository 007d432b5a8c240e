"""Grids resampled on other grids: each target cell looks up the source cells around its own place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.grid import GridSpec


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def _cubic(d: Column) -> Column:
    """Cubic convolution with a = -1/2."""
    near, far = (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2
    return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)


def _spline(d: Column) -> Column:
    """The cubic B-spline."""
    return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, F.pow(2 - d, 3) / 6).otherwise(0.0)


#: Kernels by name: how many cells they reach, and the weight at a distance in cells.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {"bilinear": (1, _linear), "cubic": (2, _cubic), "spline": (2, _spline)}


def warp(table: DataFrame, source: GridSpec, target: GridSpec, values: list[str], method: str = "bilinear", inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, `row`, `col` and `values` of the target's cells, from `table` (by, row, col, values) on the source's.

    `inverse` turns a target cell's latitude and longitude into the source's coordinates (the
    same ones, without it). A value is the mean of the source cells around the place, weighted by
    the kernel in each direction; missing cells, and those beyond the source's edge, drop out of
    the mean, and a cell whose weights come to nothing is left out. `nearest` takes the cell that
    holds the place. Target cells are a range, and they meet the source by an equi-join on cells.
    """
    if method != "nearest" and method not in KERNELS:
        raise ValueError(f"no method {method}")
    cells = table.sparkSession.range(target.n_rows * target.n_cols).select((F.col("id") / target.n_cols).cast("long").alias("row"), (F.col("id") % target.n_cols).alias("col"))
    lat, lon = F.lit(float(target.lat0)) + F.col("row") * float(target.lat_step), F.lit(float(target.lon0)) + F.col("col") * float(target.lon_step)
    if inverse is not None:
        lat, lon = inverse(lat, lon)
    placed = cells.select("row", "col", ((lat - float(source.lat0)) / float(source.lat_step)).alias("y"), ((lon - float(source.lon0)) / float(source.lon_step)).alias("x")).filter("x IS NOT NULL AND y IS NOT NULL")
    if method == "nearest":
        near = placed.select("row", "col", F.floor(F.col("y") + 0.5).alias("__r"), F.floor(F.col("x") + 0.5).alias("__c"), F.lit(1.0).alias("__w"))
    else:
        reach, kernel = KERNELS[method]
        steps = range(1 - reach, reach + 1)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
        near = placed.withColumn("n", F.explode(around)).select("row", "col", "y", "x", (F.floor("y") + F.col("n.i")).alias("__r"), (F.floor("x") + F.col("n.j")).alias("__c"))
        near = near.withColumn("__w", kernel(F.abs(F.col("y") - F.col("__r"))) * kernel(F.abs(F.col("x") - F.col("__c")))).filter("__w <> 0").select("row", "col", "__r", "__c", "__w")
    inside = near.filter(F.col("__r").between(0, source.n_rows - 1) & F.col("__c").between(0, source.n_cols - 1))
    given = table.select(*by, F.col("row").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), *[F.col(v).cast("double").alias(v) for v in values])
    joined = inside.join(given, ["__r", "__c"])
    known = {v: F.when(F.col(v).isNotNull() & ~F.isnan(v), F.col("__w")) for v in values}
    sums = joined.groupBy(*by, "row", "col").agg(*[F.sum(w * F.col(v)).alias(v) for v, w in known.items()], *[F.sum(w).alias(f"__{v}") for v, w in known.items()])
    out = sums.select(*by, "row", "col", *[F.when(F.abs(F.col(f"__{v}")) > 1e-9, F.col(v) / F.col(f"__{v}")).alias(v) for v in values])
    return out.dropna(how="all", subset=values)
