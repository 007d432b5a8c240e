"""Density clusters of points by cells.

Cells have a side of eps / sqrt(2), so that all points of a cell are within eps of
one another: a cell of `min_samples` points needs no distances to know its points for
core points, and a cell is one node. Two cells are linked if a core point of one is
within eps of one of the other. That is settled by boxes: around the core points of
a cell, then of its parts, 8 x 8 at a time, for those pairs of parts alone that boxes
leave open. No pair of points is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.graph import connected
from panelspark.storage import discard, stash

_PARTS, _LEVELS = 8, 20


def _around(cells: DataFrame) -> DataFrame:
    """Each row once for each of the 25 cells whose points may be within eps, as `nx`, `ny`."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    return cells.withColumn("__n", F.explode(near)).withColumns({"nx": F.col("cx") + F.col("__n.i"), "ny": F.col("cy") + F.col("__n.j")}).drop("__n")


def _within(eps: float) -> Column:
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return dx * dx + dy * dy <= eps * eps


def _gap(a: str, b: str, far: bool) -> Column:
    """Square of the least (or greatest) distance between points of two boxes."""

    def along(c: str) -> Column:
        lo, hi, other_lo, other_hi = F.col(f"{a}{c}0"), F.col(f"{a}{c}1"), F.col(f"{b}{c}0"), F.col(f"{b}{c}1")
        return F.greatest(other_hi - lo, hi - other_lo) if far else F.greatest(F.lit(0.0), other_lo - hi, lo - other_hi)

    return along("x") * along("x") + along("y") * along("y")


def _linked(core: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs (`u`, `v`) of nodes of cells with core points within eps; `core` has node, cx, cy, x, y."""
    limit = eps * eps
    boxes = lambda rows, keys, name: rows.groupBy(*keys).agg(*[f(c).alias(f"{name}{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    left = boxes(core, ["node", "cx", "cy"], "a")
    right = left.select(F.col("node").alias("other"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), *[F.col(f"a{c}{i}").alias(f"b{c}{i}") for c in "xy" for i in (0, 1)])
    pairs = _around(left).join(right, ["nx", "ny"]).filter(F.col("node") < F.col("other"))
    judged = lambda p: p.select("*", (_gap("a", "b", True) <= limit).alias("sure")).filter(_gap("a", "b", False) <= limit)
    found = stash(judged(pairs).select("node", "other", "sure"), "pairs")
    linked = [found.filter("sure").select("node", "other")]
    open_ = found.filter("NOT sure").select("node", "other", *[F.lit(0).cast("long").alias(c) for c in ("ap", "aq", "bp", "bq")])
    spent = [found]
    size = side
    for level in range(_LEVELS):
        if open_.isEmpty():
            break
        part = size / _PARTS
        at = lambda c, part=part, level=level: F.floor(F.col(c) / part).cast("long") if level < _LEVELS - 1 else F.col(c)
        whole = (lambda c, size=size: F.floor(F.col(c) / size).cast("long")) if level else (lambda c: F.lit(0).cast("long"))
        split = core.select("node", whole("x").alias("ap"), whole("y").alias("aq"), at("x").alias("p"), at("y").alias("q"), "x", "y")
        # Boxes of the parts of those nodes that are still open.
        busy = open_.select(F.col("node")).union(open_.select("other")).distinct()
        small = boxes(split.join(busy, "node", "left_semi"), ["node", "ap", "aq", "p", "q"], "a")
        other = small.select(F.col("node").alias("other"), F.col("ap").alias("bp"), F.col("aq").alias("bq"), F.col("p").alias("bp2"), F.col("q").alias("bq2"), *[F.col(f"a{c}{i}").alias(f"b{c}{i}") for c in "xy" for i in (0, 1)])
        near = open_.join(small, ["node", "ap", "aq"]).join(other, ["other", "bp", "bq"])
        found = stash(judged(near).select("node", "other", F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("bp2").alias("bp"), F.col("bq2").alias("bq"), "sure"), "pairs")
        sure = found.filter("sure").select("node", "other").distinct()
        linked.append(sure)
        open_ = found.filter("NOT sure").drop("sure").join(sure, ["node", "other"], "left_anti")
        spent.append(found)
        size = part
    out = linked[0]
    for more in linked[1:]:
        out = out.union(more)
    out = stash(out.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), "links")
    discard(*spent)
    return out


def density_clusters(points: DataFrame, key: str, x: str, y: str, eps: float, min_samples: int = 1) -> DataFrame:
    """`key`, `cluster` and `kind` (core, border, noise) of each point.

    A core point has `min_samples` points within eps, itself among them; core points within
    eps of one another are one cluster, named by its least core key. A border point is within
    eps of a core point and goes to the least such cluster; the rest is noise, without one.
    Points with a missing key or place take no part.
    """
    side = eps / 2**0.5
    own = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    own = own.withColumns({"cx": F.floor(F.col("x") / side).cast("long"), "cy": F.floor(F.col("y") / side).cast("long")})
    sizes = own.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    dense = stash(sizes.filter(F.col("n") >= min_samples).select("cx", "cy"), "dense")
    # Equal places are one row with a weight, so that copies do not multiply.
    places = own.groupBy("cx", "cy", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    sparse = places.join(dense, ["cx", "cy"], "left_anti")
    others = places.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("ox"), F.col("y").alias("oy"), "w")
    counted = _around(sparse.select("cx", "cy", "x", "y")).join(others, ["nx", "ny"]).filter(_within(eps)).groupBy("cx", "cy", "x", "y").agg(F.sum("w").alias("w"))
    core_places = places.join(dense, ["cx", "cy"], "left_semi").select("cx", "cy", "x", "y").union(counted.filter(F.col("w") >= min_samples).select("cx", "cy", "x", "y"))
    core_places = stash(core_places, "core")
    core = own.join(core_places, ["cx", "cy", "x", "y"], "left_semi")
    nodes = stash(core.groupBy("cx", "cy").agg(F.min("k").alias("node")), "nodes")
    links = _linked(core_places.join(nodes, ["cx", "cy"]), eps, side)
    label = connected(links).withColumnRenamed("label", "l")
    named = stash(nodes.join(label, "node", "left").select("cx", "cy", F.coalesce("l", "node").alias("cluster")), "named")
    cored = core.join(named, ["cx", "cy"]).select("k", "cluster", F.lit("core").alias("kind"))
    if min_samples > 1:
        rest = own.join(core_places, ["cx", "cy", "x", "y"], "left_anti")
        reach = core_places.join(named, ["cx", "cy"]).select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cluster")
        best = _around(rest.select("cx", "cy", "x", "y").distinct()).join(reach, ["nx", "ny"]).filter(_within(eps)).groupBy("x", "y").agg(F.min("cluster").alias("cluster"))
        border = rest.join(best, ["x", "y"], "left").select("k", "cluster", F.when(F.col("cluster").isNotNull(), "border").otherwise("noise").alias("kind"))
        cored = cored.union(border)
    return cored.withColumnRenamed("k", key)


def cluster_summary(points: DataFrame, x: str, y: str, kind: str, kinds: list[str], cluster: str = "cluster") -> DataFrame:
    """A row for each cluster: its centroid (`cx`, `cy`), how many points it has (`n`) and how many of each kind."""
    counts = [F.count_if(F.col(kind) == v).alias(f"n_{v}") for v in kinds]
    return points.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n"), *counts)
