"""Values: missing data, packing, classes, winsor bounds, spectral indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN is a missing value: make it one for SQL."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def pack(c: Column, scale: float = 1.0, offset: float = 0.0, fill: int = 65535, kind: str = "int") -> Column:
    """Scaled integers, halves to even; missing and unrepresentable values become `fill`."""
    return F.coalesce(F.bround((nan_to_null(c.cast("double")) - offset) / scale).try_cast(kind), F.lit(fill).cast(kind))


def unpack(c: Column, scale: float = 1.0, offset: float = 0.0, fill: int | None = 65535) -> Column:
    """The values of packed integers; `fill` is null."""
    value = c.cast("double") if (scale, offset) == (1.0, 0.0) else c.cast("double") * scale + offset
    return value if fill is None else F.when(c != fill, value)


def valid_range(c: Column, low: float, high: float) -> Column:
    """The value inside [low, high], else null."""
    return F.when(c.between(low, high), c)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Bounds that are null do not bind; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def classify(c: Column, cuts: list[tuple[float, str]], top: str) -> Column:
    """The first label whose cut is above the value; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, label in cuts:
        out = out.when(c < cut, label)
    return out.otherwise(top)


def dummies(c: Column, labels: list[str], prefix: str = "") -> list[Column]:
    """A boolean column for each label; a null is in none."""
    return [F.coalesce(c == x, F.lit(False)).alias(f"{prefix}{x}") for x in labels]


def undummy(flags: dict[str, Column]) -> Column:
    """The label of the last true flag, null without one."""
    return reduce(lambda out, x: F.when(x[1], x[0]).otherwise(out), flags.items(), F.lit(None).cast("string"))


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def positive(c: Column) -> Column:
    """Zero and below mean missing."""
    return F.when(c > 0, c)


def any_value_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def polynomial(c: str, degree: int) -> list[Column]:
    return [F.pow(F.col(c), F.lit(k)).alias(f"{c}_pow{k}") for k in range(2, degree + 1)]


def pairwise(columns: list[str]) -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def sorted_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
