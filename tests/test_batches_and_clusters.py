"""Greedy batches and density clusters against plain loops."""

import random

import numpy as np
import pytest

from panelspark.operators import batching, density


def greedy(sizes, max_size, max_rows):
    out, batch, used, n = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if n and (used + s > max_size or n >= max_rows):
            batch, used, n = batch + 1, 0, 0
        used, n = used + s, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize(("chunk", "max_rows", "max_size"), [(65_536, 7, 30), (16, 5, 30), (8, 8, 1000), (20, 20, 12)])
def test_batches_by_hand(spark, chunk, max_rows, max_size):
    rng = random.Random(chunk)
    groups = {"hot": 700, "one": 1, None: 90, "odd": 33}
    made = [(g, i, rng.choice([None, 0, 1, 2, 5, 9, 40])) for g, n in groups.items() for i in range(n)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "g string, o int, s int").repartition(5)
    got = {(r.g, r.o): r.batch for r in batching.batches(df, "o", "s", max_size, max_rows, "g", chunk).collect()}
    for g, n in groups.items():
        own = {o: s for h, o, s in made if h == g}
        assert [got[g, o] for o in range(n)] == greedy([own[o] for o in range(n)], max_size, max_rows)
    assert batching.batches(df.limit(0), "o", "s", 9, 2, "g").collect() == []


def by_distances(points, eps, least):
    xy = np.array([(x, y) for _, x, y in points])
    near = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = {i: points[i][0] for i in range(len(points)) if core[i]}
    moved = True
    while moved:
        moved = False
        for i in label:
            best = min(label[j] for j in np.flatnonzero(near[i]) if core[j])
            if best < label[i]:
                label[i], moved = best, True
    out = {}
    for i, (k, _, _) in enumerate(points):
        own = [label[j] for j in np.flatnonzero(near[i]) if core[j]]
        out[k] = (label[i], "core") if core[i] else (min(own), "border") if own else (None, "noise")
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 3), (3, 6)])
def test_clusters_by_hand(spark, seed, least):
    rng = random.Random(seed)
    pts = [(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(250)]
    pts += [(10 + rng.gauss(0, 0.4), 10 + rng.gauss(0, 0.4)) for _ in range(150)]  # a dense blob
    pts += [(20.0, 20.0)] * 30 + [(21.0, 20.0)] * 2  # copies, and a point exactly eps away
    # Two dense rows of points a little more and a little less than eps apart.
    pts += [(40 + i * 0.1, y) for i in range(30) for y in (0.0, 1.0000001)] + [(50 + i * 0.1, y) for i in range(30) for y in (0.0, 0.9999999)]
    made = [(i, x, y) for i, (x, y) in enumerate(pts)]
    rng.shuffle(made)
    df = spark.createDataFrame([*made, (None, 1.0, 1.0), (9999, None, 1.0)], "k int, x double, y double").repartition(4)
    got = {r.k: (r.cluster, r.kind) for r in density.density_clusters(df, "k", "x", "y", 1.0, least).collect()}
    assert got == by_distances(sorted(made), 1.0, least)
    assert density.density_clusters(df.limit(0), "k", "x", "y", 1.0, least).collect() == []
