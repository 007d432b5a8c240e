"""Polygons against points, cells and one another, by edges and buckets.

Polygons are rows (id, ring ARRAY<STRUCT<x, y>>, ordinal). A ring becomes edges, and
each edge is followed through the square buckets that it touches. Buckets that no
edge touches are wholly inside or outside, which is found out once a bucket; in
the others a point is tested against the edges of its row of buckets only, never
against a whole ring. All joins are on buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.panel import explode_years

#: Share of a bucket by which an edge's way is widened, for what floating point rounds off.
_SLACK = 1e-9


def edges(polygons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The edges (ax, ay, bx, by) of each ring of three points or more, with `id` and `keys`."""
    n = F.size("ring")
    placed = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", F.when(i == 1, n).otherwise(i - 1)).alias("b")))
    return polygons.filter(n >= 3).select("id", *(keys or []), F.explode(placed).alias("e")).select("id", *(keys or []), *[F.col(f"e.{p}.{c}").cast("double").alias(f"{p}{c}") for p in "ab" for c in "xy"])


def followed(lines: DataFrame, step: float, slack: float = _SLACK) -> DataFrame:
    """`lines` (ax, ay, bx, by, ...) once for each bucket (`cx`, `cy`) that they touch: row by row, and in a row the columns between the line's ends there.

    `slack` widens a line's way in a row by that share of a bucket.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = lines.withColumn("cy", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
    level = F.col("ay") == F.col("by")

    def at(y: Column) -> Column:
        return F.col("ax") + (F.col("bx") - F.col("ax")) * ((y - F.col("ay")) / F.when(level, F.lit(1.0)).otherwise(F.col("by") - F.col("ay")))

    one, two = at(F.greatest(low, F.col("cy") * step)), at(F.least(high, (F.col("cy") + 1) * step))
    left = F.when(level, F.least("ax", "bx")).otherwise(F.greatest(F.least(one, two), F.least("ax", "bx")))
    right = F.when(level, F.greatest("ax", "bx")).otherwise(F.least(F.greatest(one, two), F.greatest("ax", "bx")))
    return rows.withColumn("cx", F.explode(F.sequence(F.floor((left - slack * step) / step), F.floor((right + slack * step) / step))))


def _crossed(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an edge."""
    spans = (e["ay"] > y) != (e["by"] > y)
    return spans & (x < F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"])


def _on(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def _odd(row: Column, x: Column, y: Column) -> Column:
    return F.aggregate(row, F.lit(0), lambda s, e: s + F.coalesce(_crossed(e, x, y), F.lit(False)).cast("int")) % 2 == 1


def cover(polygons: DataFrame, step: float, keys: list[str] | None = None) -> DataFrame:
    """The buckets (`cx`, `cy`) of each polygon: `row` is null where one lies wholly inside, else it has the edges of the polygon in that row of buckets."""
    keys = ["id", *(keys or [])]
    sides = edges(polygons, keys[1:])
    edge = F.struct("ax", "ay", "bx", "by")
    rows = sides.withColumn("cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / step), F.floor(F.greatest("ay", "by") / step))))
    rows = rows.groupBy(*keys, "cy").agg(F.collect_list(edge).alias("row"), F.floor(F.min(F.least("ax", "bx")) / step).alias("__from"), F.floor(F.max(F.greatest("ax", "bx")) / step).alias("__to"))
    touched = followed(sides, step).select(*keys, "cx", "cy").distinct().withColumn("edge", F.lit(True))
    spread = rows.withColumn("cx", F.explode(F.sequence(F.col("__from") - 1, F.col("__to") + 1))).drop("__from", "__to")
    marked = spread.join(touched, [*keys, "cx", "cy"], "left")
    x, y = (F.col("cx") + 0.5) * step, (F.col("cy") + 0.5) * step
    return marked.filter(F.col("edge") | _odd(F.col("row"), x, y)).select(*keys, "cx", "cy", F.when(F.col("edge"), F.col("row")).alias("row"))


def inside(x: Column, y: Column, ring: Column, boundary: bool = False) -> Column:
    """Whether a point lies in a ring (even-odd rule); points on an edge count as `boundary` says."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*[F.element_at(ring, j)[c].alias(f"{p}{c}") for p, j in (("a", i), ("b", F.when(i == 1, n).otherwise(i - 1))) for c in "xy"]))
    return F.when(n >= 3, _in_row(sides, x, y, boundary)).otherwise(False)


def _in_row(row: Column, x: Column, y: Column, boundary: bool) -> Column:
    on_edge = F.exists(row, lambda e: _on(e, x, y))
    return (_odd(row, x, y) | on_edge) if boundary else (_odd(row, x, y) & ~on_edge)


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, bucket: float, overlap: str = "all", boundary: bool = False, key: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Points with the `id` of each polygon they lie in (inner join).

    `overlap` "last" keeps, for a point (columns `key`) in several, the one of the
    greatest ordinal. `on` has columns, a year say, in which both must agree.
    """
    on = on or []
    cells = cover(polygons, bucket, ["ordinal", *on])
    placed = points.withColumn("cx", F.floor(F.col(x) / bucket)).withColumn("cy", F.floor(F.col(y) / bucket))
    hit = placed.join(cells, [*on, "cx", "cy"]).filter(F.col("row").isNull() | _in_row(F.col("row"), F.col(x).cast("double"), F.col(y).cast("double"), boundary))
    if overlap == "last":
        last = hit.groupBy(*(key or [x, y])).agg(F.max_by("id", "ordinal").alias("id"))
        return points.join(last, key or [x, y])
    return hit.select(*points.columns, "id")


def rasterize(polygons: DataFrame, step: float, all_touched: bool = False, overlap: str = "all") -> DataFrame:
    """`row`, `col`, `id` of the cells (sides of `step`, counted from 0, 0) of each polygon.

    A cell belongs to a polygon whose area holds its centre; with `all_touched` also
    to one with an edge through it (a point on the line between two cells is of the upper or right one, or of both). Rows are filled between the crossings of their
    middle lines, so the work goes by edges and cells, not by points times edges.
    `overlap` "last" leaves a cell to the polygon of the greatest ordinal.
    """
    sides = edges(polygons, ["ordinal"])
    middle = (F.col("row") + 0.5) * step
    lines = sides.withColumn("row", F.explode(F.sequence(F.floor(F.least("ay", "by") / step), F.floor(F.greatest("ay", "by") / step))))
    meets = lines.filter((F.col("ay") > middle) != (F.col("by") > middle)).select("id", "ordinal", "row", ((F.col("bx") - F.col("ax")) * (middle - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))
    crossings = meets.groupBy("id", "ordinal", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    # The centre of column c, (c + 1/2) step, lies in [x0, x1).
    spans = crossings.select("id", "ordinal", "row", F.explode(F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.ceil(F.element_at("xs", i) / step - 0.5).alias("c0"), (F.ceil(F.element_at("xs", i + 1) / step - 0.5) - 1).alias("c1")))).alias("s"))
    found = spans.filter("s.c0 <= s.c1").select("id", "ordinal", "row", F.explode(F.sequence("s.c0", "s.c1")).alias("col"))
    if all_touched:
        found = found.union(followed(sides, step, 0.0).select("id", "ordinal", F.col("cy").alias("row"), F.col("cx").alias("col"))).distinct()
    if overlap == "last":
        return found.groupBy("row", "col").agg(F.max_by("id", F.struct("ordinal", "id")).alias("id")).select("row", "col", "id")
    return found.select("row", "col", "id")


def rasterize_panel(polygons: DataFrame, spells: DataFrame, step: float, years: tuple[int, int], all_touched: bool = False) -> DataFrame:
    """`row`, `col`, `year` and `n`: how many spells (id, start, end; an open end is the last year) a cell's polygons have in each year of the range. Cells without one have no row."""
    cells = rasterize(polygons, step, all_touched)
    active = explode_years(spells.select("id", "start", "end"), F.col("start"), F.col("end"), *years).groupBy("id", "year").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(active, "id").groupBy("row", "col", "year").agg(F.sum("n").alias("n"))


def _meet(a: str, b: str) -> Column:
    """Whether two segments have a point in common (ends included)."""

    def side(p: tuple[str, str], q: tuple[str, str], r: tuple[str, str]) -> Column:
        return F.signum((F.col(q[0]) - F.col(p[0])) * (F.col(r[1]) - F.col(p[1])) - (F.col(q[1]) - F.col(p[1])) * (F.col(r[0]) - F.col(p[0])))

    def ends(s: str) -> tuple[tuple[str, str], tuple[str, str]]:
        return (f"{s}ax", f"{s}ay"), (f"{s}bx", f"{s}by")

    def box(c: int) -> Column:
        (a0, a1), (b0, b1) = ends(a), ends(b)
        return (F.greatest(F.least(a0[c], a1[c]), F.least(b0[c], b1[c]))) <= F.least(F.greatest(a0[c], a1[c]), F.greatest(b0[c], b1[c]))

    (p, q), (r, s) = ends(a), ends(b)
    return box(0) & box(1) & (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)


def intersecting(left: DataFrame, right: DataFrame, bucket: float, on: list[str] | None = None) -> DataFrame:
    """Pairs (`left_id`, `right_id`) of polygons with a point in common, boundaries included; `on` has columns in which both must agree.

    Two rings meet where their edges do, which is asked bucket by bucket, or one lies
    in the other, which its first point tells.
    """
    on = on or []

    def sides(polygons: DataFrame, name: str) -> DataFrame:
        own = followed(edges(polygons, on), bucket)
        return own.select(*on, "cx", "cy", F.col("id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in ("ax", "ay", "bx", "by")])

    def firsts(polygons: DataFrame, name: str) -> DataFrame:
        return polygons.filter(F.size("ring") >= 3).select(*on, F.col("id").alias(name), F.col("ring")[0]["x"].cast("double").alias("__x"), F.col("ring")[0]["y"].cast("double").alias("__y"))

    ids = ["left_id", "right_id"]
    met = sides(left, "left").join(sides(right, "right"), [*on, "cx", "cy"]).filter(_meet("left_", "right_")).select(*ids)
    within = point_in_polygon(firsts(left, "left_id"), right, "__x", "__y", bucket, boundary=True, on=on).select("left_id", F.col("id").alias("right_id"))
    around = point_in_polygon(firsts(right, "right_id"), left, "__x", "__y", bucket, boundary=True, on=on).select(F.col("id").alias("left_id"), "right_id")
    return met.union(within).union(around).distinct()


def tile_polygons(tiles: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Tiles (`ix`: row, `iy`: column, `keys`) of a side as polygons, with their row and column as `id`."""
    corner = lambda i, j: F.struct(((F.col("iy") + i) * size).alias("x"), ((F.col("ix") + j) * size).alias("y"))
    return tiles.select(F.struct("ix", "iy").alias("id"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"), F.lit(0).alias("ordinal"), *(keys or []))
