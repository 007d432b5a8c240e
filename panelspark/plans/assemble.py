"""Assembly: several gridded sources become one panel, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.grid import GridSpec, cell_at, derived_cell
from panelspark.operators.panel import combine, fill, order_columns, update_merge
from panelspark.operators.spatial import resample, winsorize_tiles


@dataclass
class Source:
    """A long table (row, col[, year], values) on a grid `factor` times finer than the panel's."""

    name: str
    table: DataFrame
    values: list[str]
    factor: int = 1
    resampling: str = "mode"
    winsor: float | None = None
    fill: float | dict[str, float] | None = None


@dataclass
class Assembly:
    grid: GridSpec
    sources: list[Source]
    land: DataFrame | None = None  # row, col, land BOOLEAN on the finest grid
    index: list[str] = field(default_factory=lambda: ["pixel_id", "year"])
    derived: dict[str, int] = field(default_factory=dict)  # name -> factor
    policy: str = "progressive"
    pad: int = 0  # cells of the panel around a tile that count for what is computed by tile


def prepare(source: Source, plan: Assembly) -> DataFrame:
    """One source on the panel's grid: clipped by tile (with its padding), masked by land, resampled, prefixed, keyed."""
    time = [c for c in ("year",) if c in source.table.columns]
    df = source.table.select("row", "col", *time, *source.values)
    tile = plan.grid.tile * source.factor
    if source.winsor:
        df = winsorize_tiles(df, "row", "col", tile, source.values, source.winsor, plan.pad * source.factor)
    if plan.land is not None:
        keep = plan.land.filter("land").select("row", "col")
        df = df.join(keep, ["row", "col"], "left_semi").dropna(how="all", subset=source.values)
    if source.factor > 1:
        parts = [resample(df, "row", "col", source.factor, [v], source.resampling, tuple(time)) for v in source.values] if source.resampling == "mode" else [resample(df, "row", "col", source.factor, source.values, source.resampling, tuple(time))]
        df = combine(parts, [*time, "row", "col"])
    named = df.select(cell_at(F.col("row"), F.col("col"), plan.grid.tile).alias("pixel_id"), *time, *[F.col(v).cast("double").alias(f"{source.name}_{v}") for v in source.values])
    return named


def assemble(plan: Assembly, only: list[str] | None = None) -> DataFrame:
    """The panel: a null-safe full join of all sources (or those named in `only`, in the plan's order), filled, with coarser keys, in a fixed column order."""
    sources = [s for s in plan.sources if only is None or s.name in only]
    missing = set(only or []) - {s.name for s in sources}
    if missing or not sources:
        raise ValueError(f"no source {', '.join(sorted(missing)) or 'at all'}")
    panel = combine([prepare(s, plan) for s in sources], plan.index, plan.policy)
    for s in sources:
        if s.fill is not None:
            panel = fill(panel, s.fill if isinstance(s.fill, dict) else {v: s.fill for v in s.values}, f"{s.name}_")
    for name, factor in plan.derived.items():
        panel = panel.withColumn(name, derived_cell(F.col("pixel_id"), plan.grid.tile, factor))
    return order_columns(panel, plan.index, list(plan.derived), [f"{s.name}_" for s in sources])


def update(panel: DataFrame, plan: Assembly, name: str) -> DataFrame:
    """The panel with the columns of one source made anew; rows stay."""
    source = next(s for s in plan.sources if s.name == name)
    new = prepare(source, plan)
    return update_merge(panel, new, [k for k in plan.index if k in new.columns])
