"""Hard negatives and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hard_negatives as hn
from panelspark.llm import nearest as nn
from panelspark.llm.vectors import first_of_copies, matrix, row_classes

SCHEMA = "vec_id long, embedding array<{}>, label int, id string, v int, `a.b` int"


def table(spark, rows, kind="double", parts=3):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], c, "x", 1, 2) for i, v, c in rows], SCHEMA.format(kind)).repartition(parts)


def takes_part(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def hard_by_hand(rows, positives=5, negatives=10, low=30, high=90):
    whole = [(i, tuple(math.floor(x * 256) for x in v), c) for i, v, c in rows if i is not None and c is not None and takes_part(v)]
    whole = {r for r in whole if sum(x * x for x in r[1]) < 2**62}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors: dict = {}
    for i, v, c in whole:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for i, (c, v) in anchors.items():
        scored = sorted((-dot(v, w), j, k) for j, w, k in whole if j != i)
        near = [(s, j) for s, j, k in scored if k == c][:positives]
        for p, j in near:
            found = [(n, m) for n, m, k in scored if k != c and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(found)]
    return sorted(out)


def vectors(seed, n, width, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = math.exp(rng.gauss(0, spread))
        rows.append((i, [rng.gauss(0.4, 1) * size for _ in range(width)], rng.choice([0, 0, 0, 1, 2])))
    return rows


@pytest.mark.parametrize(("seed", "spread", "least"), [(1, 0.0, 2048), (2, 1.5, 16), (3, 3.0, 16)])
def test_hard_negatives_by_hand(spark, seed, spread, least, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_ROWS", least)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rows = vectors(seed, 260, 6, spread)
    copy = [1.0, 0.5, 0.25, 1.0, 1.0, 1.0]
    rows += [(1000 + i, copy, i % 3) for i in range(60)]  # copies tie
    rows += [(2000, None, 1), (2010, [float("nan")] * 6, 1), (2020, [float("inf"), 1, 1, 1, 1, 1], 1), (2030, [None, 1, 1, 1, 1, 1], 1), (2040, copy, None), (None, copy, 1)]
    rows += [(2050, [], 1), (2060, [0.0] * 6, 2), (2070, [1.0, 2.0], 0), (2080, [1e30] * 6, 0), (2090, [2e5] * 6, 1), (2091, [3e5] * 6, 0), (2092, [1e5] * 6, 1)]
    rows += rows[:15] + rows[10:12]  # repeated rows
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert [f.name for f in got.schema.fields] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == hard_by_hand(rows)


def test_buckets_end_a_search(monkeypatch):
    """Beyond the bucket whose greatest norm reaches no floor nothing is multiplied."""
    monkeypatch.setattr(hn, "BUCKET", 4)
    seen = []
    exact = hn._products
    monkeypatch.setattr(hn, "_products", lambda a, b, bound: seen.append(len(b)) or exact(a, b, bound))
    v = np.arange(40, 0, -1, dtype=float)[:, None] * 10
    rows = {"id": np.arange(40), "label": np.ones(40, np.int64), "norm": v[:, 0], "v": v}
    one = {"id": np.array([99]), "label": np.array([0]), "norm": np.array([10.0]), "v": np.array([[10.0]])}
    found = hn.search(one | {"low": np.array([[3000]]), "high": np.array([[10**6]])}, rows, 20, False)
    assert [x[2] for x in found] == list(range(11)) and len(seen) == 3
    seen.clear()
    assert [x[2] for x in hn.search(one | {"low": np.array([[-(10**6)]]), "high": np.array([[10**6]])}, rows, 3, False)] == [0, 1, 2] and len(seen) == 1


def test_hard_negatives_of_little(spark):
    assert hn.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.hard_negatives(table(spark, [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []
    few = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 0), (3, [-1.0, 0.0], 1)]
    assert sorted(map(tuple, hn.hard_negatives(table(spark, few, "float"), F.col("vec_id") % 10 == 0).collect())) == hard_by_hand(few)


def near_by_hand(rows, k, asks):
    whole = {(i, tuple(v)) for i, v, _ in rows if i is not None and takes_part(v) and any(v)}

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=False):
            s += x * y
        return s

    out = []
    for i in {i for i, _ in whole if asks(i)}:
        q = min(v for j, v in whole if j == i)
        scored = sorted((-dot(q, v), j) for j, v in whole if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_all_leaves_give_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAST_ROWS", 32)
    monkeypatch.setattr(nn, "QUERIES", 3)
    rows = vectors(5, 400, 5, 1.0)
    rows += [(1000 + i, [1.0, 0.5, 0.25, 3.0, 1.0], 0) for i in range(80)] + rows[:10]
    rows += [(2000, None, 1), (2020, [float("nan")] * 5, 1), (2040, [None] * 5, 1), (2060, [0.0] * 5, 0), (2080, [], 0), (2100, [1.0, 2.0], 0), (None, [1.0] * 5, 0)]
    got = nn.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=7, recall=1.0)
    assert sorted(map(tuple, got.collect())) == near_by_hand(rows, 7, lambda i: i % 20 == 0)


def test_visits_reach_the_recall(spark):
    """Clustered vectors: few leaves are enough, and recall is what was asked for."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 4
    v = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 12)) * 0.3
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got = nn.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, recall=0.95).collect()
    s = v[::20] @ v.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    truth = {20 * i: set(np.argsort(-x)[:20].tolist()) for i, x in enumerate(s)}
    hits = sum(r.vec_id in truth[r.query_id] for r in got)
    assert len(got) == 4000 and hits / 4000 >= 0.92


def test_ways_go_best_bin_first():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 8))
    tree = nn.fit_tree(rows, 60)
    leaf = tree.descend(rows)
    assert tree.leaves >= 40 and set(leaf.tolist()) == set(range(tree.leaves))
    (way,) = list(tree.ways(rows[:1]))
    way = list(way)
    assert sorted(way) == list(range(tree.leaves))
    best = [(rows[leaf == x] @ rows[0]).max() for x in way]
    assert np.mean(best[:10]) > np.mean(best[-10:])
    same = nn.fit_tree(np.ones((50, 3)), 10)
    assert same.leaves == 1
    assert nn.visits_for([[0, 1, 2, 3]], [[0, 0, 0, 3]], 0.75, 4) == (1, 0.75)
    assert nn.visits_for([[0, 1, 2, 3]], [[0, 0, 0, 3]], 0.9, 4) == (4, 1.0)


def test_neighbours_of_little(spark):
    assert nn.nearest(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nn.nearest(table(spark, [(0, [1.0], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    few = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (20, [0.5, 0.5], 0)]
    assert sorted(map(tuple, nn.nearest(table(spark, few, "float"), F.col("vec_id") % 20 == 0).collect())) == near_by_hand(few, 20, lambda i: i % 20 == 0)
    assert nn.nearest(table(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") % 20 == 0).collect() == []


def test_copies_and_matrices():
    import pyarrow as pa

    m = matrix(pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float32())), 2)
    assert m.tolist() == [[1, 2], [0, 0], [3, 0]]
    classes = row_classes(np.array([[0.0, 1.0], [-0.0, 1.0], [2.0, 2.0]]))
    assert classes[0] == classes[1] != classes[2]
    ids, own = np.array([5, 3, 3, 9, 1]), np.array([0, 0, 0, 0, 1])
    assert sorted(ids[first_of_copies(ids, own, 2)].tolist()) == [1, 3, 5]
