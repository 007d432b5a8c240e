"""Grid geometry as column arithmetic: cell keys, tiles, coordinates.

A cell key packs three numbers into a LONG: tile row (16 bits), tile column (16)
and the cell's place inside its tile (32). Longs are signed, so tile rows stay
below 2**15. `ix` is the tile's row and `iy` its column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_BITS, COL_BITS = 32, 16
MAX_TILE = 1 << 15
#: Labels of the coarser grids and their steps in degrees (fixed values).
RESOLUTIONS = {"500m": 0.00417, "1km": 0.01, "5km": 0.05, "50km": 0.5}


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: the centre of its first cell, its step (rows may run south) and its shape."""

    lat0: float
    lon0: float
    lat_step: float
    lon_step: float
    n_rows: int
    n_cols: int
    tile: int = 2048

    def zoom_to(self, step: float) -> GridSpec:
        """The same area on a grid of another step."""
        rows = max(1, math.ceil(self.n_rows * abs(self.lat_step) / step))
        cols = max(1, math.ceil(self.n_cols * abs(self.lon_step) / step))
        sign = math.copysign(1, self.lat_step)
        lat = self.lat0 + (sign * step - self.lat_step) / 2
        return replace(self, lat0=lat, lon0=self.lon0 + (step - self.lon_step) / 2, lat_step=sign * step, lon_step=step, n_rows=rows, n_cols=cols)

    def pad(self, cells: int) -> GridSpec:
        """The grid with `cells` more on every side."""
        return replace(self, lat0=self.lat0 - cells * self.lat_step, lon0=self.lon0 - cells * self.lon_step, n_rows=self.n_rows + 2 * cells, n_cols=self.n_cols + 2 * cells)

    def offset(self, other: GridSpec) -> tuple[int, int]:
        """Rows and columns from this grid's first cell to the other's; an error if the cells of the two do not coincide."""
        if abs(self.lat_step - other.lat_step) > 1e-12 or abs(self.lon_step - other.lon_step) > 1e-12:
            raise ValueError("grids of different steps")
        rows, cols = (other.lat0 - self.lat0) / self.lat_step, (other.lon0 - self.lon0) / self.lon_step
        if abs(rows - round(rows)) > 1e-6 or abs(cols - round(cols)) > 1e-6:
            raise ValueError("grids whose cells do not coincide")
        return round(rows), round(cols)

    def crop(self, row: int, col: int, n_rows: int, n_cols: int) -> GridSpec:
        """The part of so many cells from a cell on, as far as the grid goes."""
        r0, c0 = max(0, row), max(0, col)
        r1, c1 = min(self.n_rows, row + n_rows), min(self.n_cols, col + n_cols)
        if r1 <= r0 or c1 <= c0:
            raise ValueError("nothing is left of the grid")
        return replace(self, lat0=self.lat0 + r0 * self.lat_step, lon0=self.lon0 + c0 * self.lon_step, n_rows=r1 - r0, n_cols=c1 - c0)

    def intersect(self, other: GridSpec) -> GridSpec:
        """The cells that both grids have."""
        return self.crop(*self.offset(other), other.n_rows, other.n_cols)

    def union(self, other: GridSpec) -> GridSpec:
        """The least grid that holds both."""
        rows, cols = self.offset(other)
        r0, c0 = min(0, rows), min(0, cols)
        r1, c1 = max(self.n_rows, rows + other.n_rows), max(self.n_cols, cols + other.n_cols)
        return replace(self, lat0=self.lat0 + r0 * self.lat_step, lon0=self.lon0 + c0 * self.lon_step, n_rows=r1 - r0, n_cols=c1 - c0)

    def tile_for(self, target: float) -> int:
        """A tile size in cells that holds at least one target cell."""
        return max(self.tile, math.ceil(target / abs(self.lat_step)))

    def tiles(self, spark: SparkSession) -> DataFrame:
        """`ix`, `iy` of every tile: one range, so even a global grid has no driver loop."""
        down, across = math.ceil(self.n_rows / self.tile), math.ceil(self.n_cols / self.tile)
        if down > MAX_TILE or across > 1 << COL_BITS:
            raise ValueError("the grid has more tiles than a cell key can tell apart")
        return spark.range(down * across).select((F.col("id") / across).cast("int").alias("ix"), (F.col("id") % across).cast("int").alias("iy"))


def encode_cell(ix: Column, iy: Column, local: Column) -> Column:
    """The key of a cell; null where a part is null or out of range."""
    ok = ix.between(0, MAX_TILE - 1) & iy.between(0, (1 << COL_BITS) - 1) & local.between(0, (1 << LOCAL_BITS) - 1)
    key = F.shiftleft(ix.cast("long"), LOCAL_BITS + COL_BITS).bitwiseOR(F.shiftleft(iy.cast("long"), LOCAL_BITS)).bitwiseOR(local.cast("long"))
    return F.when(ok, key)


def decode_cell(key: Column) -> tuple[Column, Column, Column]:
    """(ix, iy, local) of a cell key."""
    ix = F.shiftrightunsigned(key, LOCAL_BITS + COL_BITS).cast("int")
    iy = F.shiftrightunsigned(key, LOCAL_BITS).bitwiseAND(F.lit((1 << COL_BITS) - 1)).cast("int")
    return ix, iy, key.bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))


def coordinate_index(value: Column, first: float, step: float, size: int) -> Column:
    """Index of the cell that holds a coordinate, clamped to the axis; `step` is negative on a falling axis."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((value - (first - step / 2)) / step))).cast("int")


def cell_of(lat: Column, lon: Column, grid: GridSpec) -> Column:
    """The key of the cell that holds a point."""
    row, col = coordinate_index(lat, grid.lat0, grid.lat_step, grid.n_rows), coordinate_index(lon, grid.lon0, grid.lon_step, grid.n_cols)
    return cell_at(row, col, grid.tile)


def cell_at(row: Column, col: Column, tile: int) -> Column:
    local = F.pmod(row, F.lit(tile)).cast("long") * tile + F.pmod(col, F.lit(tile))
    return encode_cell(F.floor(row / tile), F.floor(col / tile), local)


def derived_cell(key: Column, tile: int, factor: int) -> Column:
    """The key of the coarser cell, `factor` cells wide, of the same tile."""
    ix, iy, local = decode_cell(key)
    per_row = -(-tile // factor)
    row, col = F.floor(local / tile / factor), F.floor(F.pmod(local, F.lit(tile)) / factor)
    return encode_cell(ix, iy, row * per_row + col)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sinusoidal_inverse(x: Column, y: Column, radius: float = 6371007.181) -> tuple[Column, Column]:
    """(lat, lon) in degrees of sinusoidal metres; lon is null at the poles and off the globe."""
    lat = F.degrees(y / radius)
    lon = F.degrees(F.try_divide(x, radius * F.cos(y / radius)))
    return F.when(F.abs(lat) <= 90, lat), F.when((F.abs(lat) < 90) & (F.abs(lon) <= 180), lon)
