"""Connected components over an edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import discard, packed, stash

#: Parts that a node's neighbours are dealt to, so that the centre of a star is no task's alone.
SALTS = 32


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(near: DataFrame) -> DataFrame:
    """`near` (u, v) with `m`, the least of u and its neighbours, which may be as many as there are rows.

    Neighbours are dealt to SALTS parts. The least of each part is found first, and
    the least of a node's parts goes back to the parts, so a key of the two joins
    has SALTS rows or those of one part.
    """
    dealt = near.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_set("s").alias("s"))
    return dealt.join(least.select("u", F.explode("s").alias("s"), "m"), ["u", "s"]).select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: nobody links twice, and nobody who links is linked to."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
    return odd.isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`id` and `root`, the least id of its component, for each id in `edges` (columns `u` and `v`).

    Each step relinks a node's neighbours to the least of them: aggregates and
    joins whose rows never outnumber the edges. The rounds grow with the log of
    the longest path. Self-loops are allowed; an empty edge table gives no rows.
    `edges` is counted first, which is cheap for a stashed table.
    """
    most = 2 * edges.count()
    edges = stash(packed(edges.select("u", "v").distinct(), most), "edges")
    nodes = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        if _settled(now):
            break
        # Large-star: every larger neighbour of u links to the least node around u.
        large = _with_least(_both(now)).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small-star: u and its smaller neighbours link to the least of them.
        down = stash(packed(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct(), most), "edges")
        near = _with_least(down)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        before, now = now, stash(packed(small.filter(F.col("u") != F.col("v")).distinct(), most), "edges")
        discard(down, before)
    else:
        raise RuntimeError("components did not settle")
    out = stash(packed(nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root")), most), "roots")
    discard(edges, now)
    return out
