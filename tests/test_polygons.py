"""Polygons against brute force on random rings."""

import math
import random

import pytest

from panelspark.operators import polygons as pg

RING = "id int, ring array<struct<x:double,y:double>>, ordinal int, year int"


def rings(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy, k = rng.uniform(-5, 25), rng.uniform(-5, 25), rng.randint(3, 14)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(k))
        out.append((i, [(cx + math.cos(t) * r, cy + math.sin(t) * r) for t in turns for r in [rng.uniform(0.3, 7)]], rng.randint(0, 9), i % 2))
    return [*out, (n, [(1.0, 1.0), (2.0, 2.0)], 0, 0), (n + 1, [(0.53, 0.54), (0.61, 0.55), (0.6, 0.63)], 50, 1)]


def sides(ring):
    return [(ring[i], ring[i - 1]) for i in range(len(ring))] if len(ring) > 2 else []


def holds(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides(ring)) % 2 == 1


def through(a, b, box):
    lo, hi = 0.0, 1.0
    for c in (0, 1):
        d = b[c] - a[c]
        if d == 0:
            if not box[0][c] <= a[c] <= box[1][c]:
                return False
            continue
        s, t = sorted(((box[0][c] - a[c]) / d, (box[1][c] - a[c]) / d))
        lo, hi = max(lo, s), min(hi, t)
    return lo <= hi


def frame(spark, made):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring], o, year) for i, ring, o, year in made], RING)


def test_points_by_buckets(spark):
    made = rings(1, 25)
    rng = random.Random(2)
    pts = [(k, rng.uniform(-12, 32), rng.uniform(-12, 32), k % 2) for k in range(1500)]
    df = spark.createDataFrame(pts, "k int, x double, y double, year int")
    for bucket in (0.7, 5.0, 100.0):
        got = {(r.k, r.id) for r in pg.point_in_polygon(df, frame(spark, made), "x", "y", bucket).collect()}
        assert got == {(k, i) for k, x, y, _ in pts for i, ring, _, _ in made if holds(ring, x, y)}
    got = {(r.k, r.id) for r in pg.point_in_polygon(df, frame(spark, made), "x", "y", 2.0, on=["year"]).collect()}
    assert got == {(k, i) for k, x, y, z in pts for i, ring, _, year in made if z == year and holds(ring, x, y)}


@pytest.mark.parametrize("step", [1.0, 0.5])
def test_cells_by_hand(spark, step):
    made = rings(3, 20)
    cells = [(r, c) for r in range(-30, 80) for c in range(-30, 80)]
    centre = {(r, c, i) for r, c in cells for i, ring, _, _ in made if holds(ring, (c + 0.5) * step, (r + 0.5) * step)}
    edge = {(r, c, i) for i, ring, _, _ in made for a, b in sides(ring) for r, c in cells if through(a, b, ((c * step, r * step), ((c + 1) * step, (r + 1) * step)))}
    assert {tuple(r) for r in pg.rasterize(frame(spark, made), step).collect()} == centre
    assert {tuple(r) for r in pg.rasterize(frame(spark, made), step, all_touched=True).collect()} == centre | edge
    best = {}
    order = {i: (o, i) for i, _, o, _ in made}
    for r, c, i in centre:
        best[r, c] = max(best.get((r, c), i), i, key=lambda x: order[x])
    assert {(r.row, r.col): r.id for r in pg.rasterize(frame(spark, made), step, overlap="last").collect()} == best


def test_pairs_by_hand(spark):
    def meet(p, q):
        def side(a, b, c):
            v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            return (v > 0) - (v < 0)

        if any(side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0 for a, b in sides(p) for c, d in sides(q)):
            return True
        return holds(p, *q[0]) or holds(q, *p[0])

    a, b = rings(4, 18), rings(5, 18)
    want = {(i, j) for i, p, _, _ in a for j, q, _, _ in b if len(p) > 2 and len(q) > 2 and meet(p, q)}
    for bucket in (1.0, 8.0):
        assert {tuple(r) for r in pg.intersecting(frame(spark, a), frame(spark, b), bucket).collect()} == want
    years = {i: y for made in (a, b) for i, _, _, y in made}
    assert {tuple(r) for r in pg.intersecting(frame(spark, a), frame(spark, b), 3.0, on=["year"]).collect()} == {(i, j) for i, j in want if years[i] == years[j]}
    # Boundaries count: squares that share a side, and a corner.
    squares = frame(spark, [(i, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], 0, 0) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (4.0, 4.0)])])
    assert {tuple(r) for r in pg.intersecting(squares, squares, 1.0).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 0), (1, 2), (2, 1)}
