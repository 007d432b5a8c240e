"""Tiles, resampling and distances as DataFrame operations.

Range conditions are turned into equi-joins on square buckets, with the exact test
after the join, so no nested-loop join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.density import density_clusters
from panelspark.operators.polygons import inside, point_in_polygon
from panelspark.operators.quantiles import join_keys, quantiles
from panelspark.operators.stats import aggregate_of, modal
__all__ = ["buffer_counts", "clusters", "inside", "neighbours", "point_in_polygon", "resample", "spread_cells", "winsorize", "winsorize_tiles", "with_halo"]


def winsorize(df: DataFrame, by: list[str], values: list[str], q: float, pool: DataFrame | None = None) -> DataFrame:
    """Values clipped to the exact q and 1 - q quantiles of their group (linear, missing values left out).

    `pool` has the rows that the quantiles are taken over, where these are not `df` itself: with
    the cells around a tile, say.
    """
    bounds = quantiles(df if pool is None else pool, by, values, [q, 1 - q]).withColumnsRenamed({v: f"__{v}" for v in values})
    joined = join_keys(df, bounds, by)
    clipped = [F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), F.col(f"__{v}")[0]), F.col(f"__{v}")[1])).alias(v) for v in values]
    return joined.select(*[c for c in df.columns if c not in values], *clipped)


def with_halo(df: DataFrame, row: str, col: str, tile: int, pad: int) -> DataFrame:
    """Every cell in its own tile and in those whose padding holds it: `ix` and `iy` are added.

    Only cells within `pad` of a border are sent to a neighbour (or to several, where `pad` is wider than a tile).
    """

    def tiles(c: str) -> Column:
        return F.sequence(F.greatest(F.floor((F.col(c) - pad) / tile), F.lit(0)), F.floor((F.col(c) + pad) / tile))

    return df.withColumn("ix", F.explode(tiles(row))).withColumn("iy", F.explode(tiles(col)))


def winsorize_tiles(df: DataFrame, row: str, col: str, tile: int, values: list[str], q: float, pad: int = 0) -> DataFrame:
    """Values clipped to the quantiles of their tile and of `pad` cells around it; cells stay where they are, once."""
    own = df.withColumns({"ix": F.floor(F.col(row) / tile), "iy": F.floor(F.col(col) / tile)})
    return winsorize(own, ["ix", "iy"], values, q, with_halo(df, row, col, tile, pad) if pad else None).drop("ix", "iy")


def resample(df: DataFrame, row: str, col: str, factor: int, values: list[str], how: str = "mode", by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a grid `factor` times coarser: mode (ties: the least), average, sum, nearest, or any other aggregate."""
    keys = [*by, "row", "col"]
    coarse = df.select(*by, *[c for c in values], F.floor(F.col(row) / factor).alias("row"), F.floor(F.col(col) / factor).alias("col"), F.pmod(row, F.lit(factor)).alias("__r"), F.pmod(col, F.lit(factor)).alias("__c"))
    if how == "mode" and len(values) == 1:
        return modal(coarse, keys, values[0])
    if how == "nearest":
        middle = factor // 2
        far = F.struct(F.abs(F.col("__r") - middle) + F.abs(F.col("__c") - middle), "__r", "__c")
        return coarse.groupBy(*keys).agg(*[F.min_by(v, far).alias(v) for v in values])
    name = {"average": "mean"}.get(how, how)
    return coarse.groupBy(*keys).agg(*[aggregate_of(name, F.col(v), ddof=0).alias(v) for v in values])


def neighbours(left: DataFrame, right: DataFrame, xy: tuple[str, str], other: tuple[str, str], radius: float) -> DataFrame:
    """Pairs within a planar distance: the right side goes to the 3 x 3 buckets around it, then an equi-join and the exact test."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = right.withColumn("__n", F.explode(around)).withColumn("__bx", F.floor(F.col(other[0]) / radius) + F.col("__n.i")).withColumn("__by", F.floor(F.col(other[1]) / radius) + F.col("__n.j")).drop("__n")
    placed = left.withColumn("__bx", F.floor(F.col(xy[0]) / radius)).withColumn("__by", F.floor(F.col(xy[1]) / radius))
    dx, dy = F.col(xy[0]) - F.col(other[0]), F.col(xy[1]) - F.col(other[1])
    return placed.join(spread, ["__bx", "__by"]).filter(dx * dx + dy * dy <= radius * radius).drop("__bx", "__by")


def buffer_counts(cells: DataFrame, sites: DataFrame, xy: tuple[str, str], other: tuple[str, str], radius: float, key: str) -> DataFrame:
    """How many sites lie within `radius` of each cell, by `key`; cells without one have 0.

    Places are what meets, not rows: each distinct place of cells is paired with the distinct
    places of sites near it, which count for as many sites as stand there. Rows of one key
    add up, and each has their sum.
    """
    at = sites.groupBy(*other).agg(F.count(F.lit(1)).alias("__w"))
    n = neighbours(cells.select(*xy).distinct(), at, xy, other, radius).groupBy(*xy).agg(F.sum("__w").alias("__w"))
    by_key = cells.select(key, *xy).join(n, list(xy)).groupBy(key).agg(F.sum("__w").alias("n_sites"))
    return cells.join(by_key, key, "left").fillna(0, ["n_sites"])


def clusters(points: DataFrame, key: str, x: str, y: str, eps: float) -> DataFrame:
    """`key` and `cluster` (its least key) of points linked by steps of at most `eps` (density clustering with one point enough)."""
    return density_clusters(points, key, x, y, eps).drop("kind")


def spread_cells(df: DataFrame, by: list[str], order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each cell, by order: the mosaic of overlapping swaths. Of rows of one order the first by `ties`."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), *ties)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
