"""Connected components of an edge table, for graphs whose nodes may be many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.storage import discard, settled, stash


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """`node` and `label`, the least node of its component, for each node of `edges` (columns `u` and `v`, one type).

    Each round a node, and the node that its label names, take the least label at
    the other ends of their edges, and labels jump to their label's label; rounds
    grow with the log of the longest path. Self-loops are allowed; nulls are not nodes.
    """
    pairs = stash(edges.select("u", "v").dropna().distinct(), "edges")
    rows = 2 * pairs.count()
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels", rows)
    for _ in range(max_rounds):
        ends = both.join(label.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(label.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        told = ends.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("lv").alias("l")), F.struct(F.col("lu").alias("node"), F.col("lv").alias("l")))).alias("t")).groupBy("t.node").agg(F.min("t.l").alias("l"))
        hooked = settled(label.join(told, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was")), "labels", rows)
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = settled(hooked.join(jump, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")), "labels", rows)
        moved = not after.filter("moved").isEmpty()
        discard(label, hooked)
        label = after.drop("moved") if moved else after
        if not moved:
            discard(pairs)
            return label.select("node", "label")
        label = settled(label, "labels", rows)
        discard(after)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
