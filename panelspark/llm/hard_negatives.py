"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and cut into buckets. By Cauchy and Schwarz no
score of a bucket is above the anchor's norm times the bucket's greatest, so an
anchor leaves a bucket, and all that follow, once that is below the least of its
windows' floors: a window's lower limit or, when it is full, its k-th score so far.

Spark deals norm ranges to cells beside blocks of anchors that need about the same
norm; pairs of ranges out of reach are not dealt at all. The range of the greatest
norms goes first, and its k-th scores are floors for the others. Only the best k
of a window leave a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, read_table, stash
from panelspark.llm.vectors import cells, finite, first_of_copies, leading, matrix, row_classes

#: Rows of a bucket, anchors of a cell, candidates of a cell at most and at least.
BUCKET, ANCHORS, MOST_ROWS, LEAST_ROWS = 2048, 1024, 65_536, 2048
#: Ranges of norms, and of what norms anchors need.
NORM_RANGES, NEED_RANGES = 64, 16
#: Products of doubles are exact sums of whole numbers below this.
EXACT = 2.0**53
#: Squared norms of rows that take part are below this, so that scores are longs.
LARGEST = 2.0**62
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_SLACK = 1 + 1e-9


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    return np.rint(a @ b.T).astype(np.int64) if bound < EXACT / 2 else a.astype(np.int64) @ b.astype(np.int64).T


def search(anchors: dict, rows: dict, k: int, same: bool) -> list[tuple[int, int, int, int]]:
    """(anchor, window, id, score) of each anchor's `k` first rows in each window [low, high], of its own label or of others.

    `rows` lie by norm, greatest first. `low` and `high` are whole numbers, anchors by windows.
    """
    floor, high = anchors["low"].copy(), anchors["high"]
    held = [(np.zeros(0, np.int64),) * 3 for _ in range(floor.shape[1])]
    for at in range(0, len(rows["id"]), BUCKET):
        part = {c: x[at : at + BUCKET] for c, x in rows.items()}
        reach = anchors["norm"] * part["norm"][0] * _SLACK + 1
        active = np.flatnonzero(reach >= floor.min(axis=1))
        if not active.size:
            break
        scores = _products(anchors["v"][active], part["v"], float(reach.max()))
        allowed = (anchors["label"][active][:, None] == part["label"]) == same
        allowed &= anchors["id"][active][:, None] != part["id"]
        for w in range(floor.shape[1]):
            hit = allowed & (scores >= floor[active, w][:, None]) & (scores <= high[active, w][:, None])
            many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
            if many.size:
                some = np.where(hit[many], scores[many], _MIN)
                hit[many] &= scores[many] >= np.partition(some, some.shape[1] - k, axis=1)[:, -k][:, None]
            a, c = np.nonzero(hit)
            if not a.size:
                continue
            own, ids, score = (np.concatenate(x) for x in zip(held[w], (active[a], part["id"][c], scores[a, c]), strict=True))
            best = leading(own, score, ids, k)
            own, ids, score = own[best], ids[best], score[best]
            held[w] = (own, ids, score)
            full = np.flatnonzero(np.bincount(own, minlength=len(floor)) == k)
            last = np.full(len(floor), _MAX)
            np.minimum.at(last, own, score)
            floor[full, w] = np.maximum(floor[full, w], last[full])
    return [(int(a), w, int(i), int(s)) for w, (own, ids, score) in enumerate(held) for a, i, s in zip(own, ids, score, strict=True)]


def _whole(table: pa.Table, width: int, scale: float) -> dict:
    v = np.floor(matrix(table["v"], width) * scale)
    return {"id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "norm": table["norm"].to_numpy(), "v": v}


def _sorted(rows: dict, k: int) -> dict:
    """Candidates by norm, copies beyond the first `k` and the anchor itself left out: they cannot be in a window."""
    keep = first_of_copies(rows["id"], row_classes(np.column_stack([row_classes(rows["v"]), rows["label"]])), k + 1)
    keep = keep[np.argsort(-rows["norm"][keep], kind="stable")]
    return {c: x[keep] for c, x in rows.items()}


def _positives(width: int, scale: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            anchors = _whole(left, width, scale)
            anchors |= {"low": np.full((len(left), 1), _MIN), "high": np.full((len(left), 1), _MAX)}
            found = [(int(anchors["id"][a]), i, s) for a, _, i, s in search(anchors, _sorted(_whole(right, width, scale), k), k, True)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_id", "positive_id", "positive_score"), columns, strict=True)})

    return run


def _negatives(width: int, scale: float, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            anchors = _whole(left, width, scale)
            windows = left["windows"].to_pylist()
            most = max(map(len, windows))
            # Floors and ceilings in whole numbers of any size; an empty window is one that nothing enters.
            lows = [[max(-(-low * p["positive_score"] // 100), p["floor"]) for p in own] + [_MAX] * (most - len(own)) for own in windows]
            highs = [[high * p["positive_score"] // 100 for p in own] + [_MIN] * (most - len(own)) for own in windows]
            anchors |= {"low": np.array(lows, np.int64), "high": np.array(highs, np.int64)}
            for a, w, i, s in search(anchors, _sorted(_whole(right, width, scale), k), k, False):
                found.append((int(anchors["id"][a]), windows[a][w]["positive_id"], i, windows[a][w]["positive_score"], s))
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), columns, strict=True)})

    return run


def _cuts(rows: DataFrame, value: str, ranges: int) -> list[float]:
    """Values that part the rows into `ranges` of about the same size; fewer where many are equal."""
    if ranges < 2:
        return []
    found = rows.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000)).first()[0]
    return sorted(set(found or []))


def _range_of(value: str, cuts: list[float]) -> Column:
    """How many cuts are above a value: 0 for the range of the greatest values."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c > F.col(value))) if cuts else F.lit(0)


def _ranked(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank` (int, from 1), `negative_id`, `positive_score`, `negative_score` (long).

    Components become floor(scale * x); a score is the whole inner product, the
    greater the nearer, ties by the lesser id. An anchor (a row where `anchor`
    holds) has as positives its first `positives` other rows of the same label;
    each positive gets the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, or all
    of them, if fewer (none where the positive's score is negative).

    Rows with a null id, label or vector, or a component that is null or not
    finite, take no part, nor do those whose squared norm (after scaling) is 2^62 or more: their
    scores may pass a long. Shorter vectors, empty ones too, count as ended by
    zeros. Of anchors with the same id the one of the least (label, vector) counts;
    candidates with the same id, label and vector count once, others each.
    An empty table gives an empty table; columns of other names are not read.
    """
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("v"), anchor.alias("anchor"))
    whole = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    clean = stash(whole.withColumn("norm", F.sqrt(square)).filter(F.col("norm") < LARGEST**0.5), "vectors")
    n, width = clean.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    cell = min(MOST_ROWS, max(LEAST_ROWS, -(-n // (2 * partitions(rows.sparkSession)))))
    asks = clean.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "v", "norm")).alias("a")).select("id", "a.*")
    pool = clean.drop("anchor")

    labels = asks.select(F.col("label").alias("g")).distinct().withColumn("h", F.col("g"))
    near = cells(asks.withColumn("g", F.col("label")), pool.withColumn("h", F.col("label")), labels, ANCHORS, cell).applyInArrow(_positives(width, scale, positives), "anchor_id long, positive_id long, positive_score long")
    best = _ranked(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank")
    # Null floors stand for no bound; windows that nothing can enter are left out.
    pairs = stash(best.filter("positive_score >= 0"), "positives")
    bare = pairs.withColumn("floor", F.lit(_MIN))

    cuts = _cuts(pool, "norm", min(NORM_RANGES, -(-n // cell)))
    ranged = pool.withColumn("h", _range_of("norm", cuts))
    most = {r.h: r.most for r in ranged.groupBy("h").agg(F.max("norm").alias("most")).collect()}
    run = _negatives(width, scale, negatives, low, high)
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"

    def against(windows: DataFrame, ranges: list[int]) -> DataFrame | None:
        """Anchors with their windows against the given ranges of norms, as far as one reaches the other."""
        grouped = windows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score", "floor")).alias("windows"), F.min(F.greatest(F.col("positive_score") * (low / 100), F.col("floor").cast("double"))).alias("least"))
        needing = stash(asks.join(grouped, "id").withColumn("need", F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(0.0)), "anchors")
        parts = min(NEED_RANGES, -(-needing.count() // ANCHORS))
        told = needing.withColumn("g", _range_of("need", _cuts(needing, "need", parts))).drop("least", "need")
        need = {r.g: r.need for r in needing.withColumn("g", _range_of("need", _cuts(needing, "need", parts))).groupBy("g").agg(F.min("need").alias("need")).collect()}
        reached = [(g, h) for g, x in need.items() for h in ranges if x <= most[h] * _SLACK + 1]
        if not reached:
            return None
        return cells(told, ranged, rows.sparkSession.createDataFrame(reached, "g int, h int"), ANCHORS, cell).applyInArrow(run, schema)

    keys = ["anchor_id", "positive_id", "positive_score"]
    empty = rows.sparkSession.createDataFrame([], schema)
    found = against(bare, sorted(most)[:1]) if most else None
    found = empty if found is None else found
    if len(most) > 1:
        first = stash(_ranked(found, keys, "negative_score", "negative_id", negatives), "negatives")
        full = first.filter(F.col("rank") == negatives).select("anchor_id", "positive_id", F.col("negative_score").alias("reached"))
        floored = pairs.join(full, ["anchor_id", "positive_id"], "left").withColumn("floor", F.coalesce("reached", F.lit(_MIN))).drop("reached")
        rest = against(floored, sorted(most)[1:])
        found = first.drop("rank") if rest is None else first.drop("rank").union(rest.select(*first.drop("rank").columns))
    out = _ranked(found, keys, "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT * FROM ranked WHERE rank <= 10
"""
