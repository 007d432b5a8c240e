"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample of at most SAMPLE rows (by hash of the id), the only
rows that meet on the driver; every row is then sent down to a leaf. A query walks
the tree best bin first: a priority queue gives the node of the greatest expected
inner product, an inner node puts its children into the queue, a leaf is visited.
How many leaves to visit is calibrated: at most CALIBRATION of the queries are
searched exactly, and visits widen until the leaves on their ways hold the share
`recall` of their true neighbours.

Visits run in two waves of cells (a block of a leaf's queries beside a block of its
rows). The first few leaves of each way give a query its k-th score so far, and the
other leaves return only what reaches it.
"""

from __future__ import annotations

import heapq
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, read_table, sliced, stash
from panelspark.llm.vectors import cells, finite, first_of_copies, leading, matrix, row_classes

#: Rows that the tree is fitted on, queries that calibrate, leaves: at most.
SAMPLE, CALIBRATION, LEAVES = 20_000, 256, 4096
#: Children of a node, rounds of k-means.
BRANCHING, ROUNDS = 16, 10
#: Leaves of the first wave.
FIRST = 4
#: Queries of a cell, rows of a cell at most and at least, scores held at once.
QUERIES, MOST_ROWS, LEAST_ROWS, AT_ONCE = 2048, 65_536, 2048, 4_000_000


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster (0, 1, ...; none empty) of each row."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    own = np.zeros(len(rows), np.int64)
    for _ in range(ROUNDS):
        own = np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        own = np.unique(own, return_inverse=True)[1]
        n = np.bincount(own)
        centres = np.stack([np.bincount(own, rows[:, j], len(n)) for j in range(rows.shape[1])], axis=1) / n[:, None]
    return own


@dataclass
class Tree:
    """Nodes with their centre, the root mean square distance of their rows and their children; leaves are numbered."""

    centres: list[np.ndarray] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, rows: np.ndarray, most: int, rng: np.random.Generator) -> int:
        """Adds a node over `rows` and its descendants down to leaves of `most` rows or of equal ones; returns its number."""
        node, centre = len(self.centres), rows.mean(axis=0)
        self.centres.append(centre)
        self.spread.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        own = _k_means(rows, min(BRANCHING, -(-len(rows) // most)), rng) if len(rows) > most else np.zeros(len(rows), np.int64)
        if own.max() == 0:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self.grow(rows[own == c], most, rng) for c in range(own.max() + 1)]
        return node

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(rows), np.int32)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            c = np.stack([self.centres[x] for x in self.children[node]])
            near = np.argmin((c * c).sum(axis=1) - 2 * rows[at] @ c.T, axis=1)
            waiting += [(x, at[near == i]) for i, x in enumerate(self.children[node]) if (near == i).any()]
        return out

    def ways(self, queries: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first: by the inner product expected of a node's better rows."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        hope = queries @ np.stack(self.centres).T + 2 / math.sqrt(queries.shape[1] or 1) * norms[:, None] * np.array(self.spread)
        for own in hope.tolist():
            yield self._way(own)

    def _way(self, hope: list[float]) -> Iterator[int]:
        queue = [(-hope[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (-hope[c], c))
            else:
                yield self.leaf[node]


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 0) -> Tree:
    tree = Tree()
    tree.grow(sample, max(1, -(-len(sample) // leaves)), np.random.default_rng(seed))
    return tree


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components, so that copies score alike wherever they are."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += queries[:, j] * rows[:, j]
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's `k` best rows that score `least` or more, without its own id."""
    keep = first_of_copies(ids, row_classes(rows), k + 1)
    rows, ids = rows[keep], ids[keep]
    reach = np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1).max(initial=0.0))
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(queries), max(1, AT_ONCE // max(1, len(rows)))):
        part = slice(at, at + max(1, AT_ONCE // max(1, len(rows))))
        scores = queries[part] @ rows.T
        scores[query_ids[part][:, None] == ids] = -np.inf
        # A rounding error below the k-th, or the least: what is cut off here cannot come back by the exact sum.
        floor = np.full(len(scores), -np.inf) if len(ids) <= k else np.partition(scores, len(ids) - k, axis=1)[:, -k]
        floor = np.maximum(floor, least[part]) - 1e-12 * reach[part]
        q, r = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        exact = exact_scores(queries[part][q], rows[r])
        own = exact >= least[part][q]
        q, r, exact = q[own], r[own], exact[own]
        best = leading(q, exact, ids[r], k)
        out.append((q[best] + at, ids[r[best]], exact[best]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(none, *out, strict=True))


def _visit(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = left["id"].to_numpy() if len(left) else np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if len(left) and len(right):
            found = best_of(matrix(left["v"], width), ids, left["least"].to_numpy(), matrix(right["v"], width), right["id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(ids[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def visits_for(ways: list[list[int]], truth: list[list[int]], recall: float, leaves: int) -> tuple[int, float]:
    """Leaves to visit, widened by a quarter until the first ones of each way hold `recall` of the true neighbours' leaves; and the share they hold."""
    places = [[way.index(leaf) for leaf in own] for way, own in zip(ways, truth, strict=True)]
    flat = np.array([p for own in places for p in own], np.int64)
    visits = 1
    while flat.size and visits < leaves and (flat < visits).mean() < recall:
        visits = min(leaves, max(visits + 1, math.ceil(visits * 1.25)))
    return visits, float((flat < visits).mean()) if flat.size else 1.0


def nearest(
    rows: DataFrame,
    query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    recall: float = 0.96,
    leaves: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """`query_id`, `rank` (int, from 1), `vec_id`, `score` (double): each query's `k` nearest found of all other rows, by inner product.

    Queries are the rows where `query` holds. Ties go to the lesser id; scores are
    sums in the order of the components, in double precision. `recall` is what the
    calibration asks of the visited leaves; `leaves` is the size of the tree, by
    default the square root of the number of rows, LEAVES at most.

    Rows with a null id, or a vector that is null, empty, zero or holds null or
    non-finite components, take no part. Shorter vectors count as ended by zeros.
    A query never finds its own id; rows with the same id and vector count once,
    rows that share an id only, each. Of queries with the same id the one of the
    least vector asks. A query goes on past the calibrated visits until its leaves
    hold enough rows, so that `k` (all, if fewer) are found. An empty table gives
    an empty table; columns of other names are not read.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), query.alias("asks"))
    clean = own.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    n, width = clean.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = matrix(clean.filter(share < SAMPLE / n).select("v").toArrow()["v"], width)
    sample = sample if len(sample) else matrix(clean.select("v").limit(1).toArrow()["v"], width)
    tree = fit_tree(sample, min(LEAVES, leaves or math.isqrt(n)), seed)
    sent = spark.sparkContext.broadcast(tree)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 10_000):
            leaf = sent.value.descend(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "h"])

    element = clean.schema["v"].dataType.simpleString()
    placed = stash(clean.mapInArrow(down, f"id long, v {element}, asks boolean, h int"), "leaves")
    asking = placed.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    held = {r.h: r.n for r in placed.groupBy("h").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}

    # Calibration: a bounded number of queries against all rows.
    n_queries = asking.count()
    trial = asking.filter(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30) < CALIBRATION / max(1, n_queries)).toArrow()
    trials = spark.sparkContext.broadcast((matrix(trial["v"], width), trial["id"].to_numpy()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ids = trials.value
        for batch in sliced(batches, 10_000):
            q, near, score = best_of(vectors, ids, np.full(len(ids), -np.inf), matrix(batch.column(1), width), batch.column(0).to_numpy(), k)
            leaf = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score), "h": pa.array([leaf[x] for x in near.tolist()], pa.int32())})

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    visits, calibrated = 1, 1.0
    if len(trial):
        truth: dict[int, list[int]] = {i: [] for i in trial["id"].to_pylist()}
        for r in ranked(placed.select("id", "v", "h").mapInArrow(compared, f"{schema}, h int")).collect():
            truth[r.query_id].append(r.h)
        visits, calibrated = visits_for([list(w) for w in tree.ways(trials.value[0])], [truth[i] for i in trial["id"].to_pylist()], recall, tree.leaves)
    logging.getLogger(__name__).info("%d of %d leaves hold %.3f of the true neighbours", visits, tree.leaves, calibrated)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            at: list[int] = []
            leaf: list[int] = []
            place: list[int] = []
            for i, way in enumerate(sent.value.ways(matrix(batch.column(1), width))):
                got = 0
                for p, x in enumerate(way):
                    if p >= visits and got >= 2 * k + 2:
                        break
                    got += held.get(x, 0)
                    at.append(i)
                    leaf.append(x)
                    place.append(p)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int32())).columns, pa.array(leaf, pa.int32()), pa.array(place, pa.int32())], ["id", "v", "g", "place"])

    ways = stash(asking.mapInArrow(walk, f"id long, v {element}, g int, place int"), "ways")
    members = placed.select("id", "v", "h")
    cell = min(MOST_ROWS, max(LEAST_ROWS, -(-n // (2 * partitions(spark)))))
    equal = spark.createDataFrame([(x, x) for x in held], "g int, h int")

    def visited(queries: DataFrame) -> DataFrame:
        return cells(queries.select("id", "v", "g", "least"), members, equal, QUERIES, cell).applyInArrow(_visit(width, k), schema)

    first = stash(ranked(visited(ways.filter(F.col("place") < FIRST).withColumn("least", F.lit(float("-inf"))))).drop("rank"), "found")
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    later = ways.filter(F.col("place") >= FIRST).join(reached, "id", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf"))))
    out = ranked(first.union(visited(later)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
