"""Exact quantiles against numpy, with and without narrowing."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.operators import quantiles as q
from panelspark.operators import stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, v double, w double").repartition(5)


def rows(seed):
    rng = random.Random(seed)
    made = [("hot", 1, rng.gauss(0, 1) ** 5 * 10 ** rng.randint(-3, 200), rng.choice([1.0, 1.0, 1.0, 2.0, rng.random()])) for _ in range(4000)]
    made += [("ties", 1, float(rng.choice([3, 3, 3, 7])), -0.5) for _ in range(1500)] + [(None, 2, rng.random(), None) for _ in range(700)]
    made += [(f"s{i % 40}", i % 3, rng.random(), float(i % 5)) for i in range(500)] + [("none", 1, None, 1.0), ("one", None, 5.0, None)]
    return made


@pytest.mark.parametrize("big", [1_000_000, 60, 1])
def test_quantiles_as_numpy(spark, big):
    made = rows(1)
    got = {(r.g, r.y): (r.v, r.w) for r in q.quantiles(table(spark, made), ["g", "y"], ["v", "w"], PROBS, big).collect()}
    assert len(got) == len({(g, y) for g, y, _, _ in made})
    for (g, y), found in got.items():
        for i in (0, 1):
            own = [r[2 + i] for r in made if (r[0], r[1]) == (g, y) and r[2 + i] is not None]
            if not own:
                assert found[i] is None
                continue
            low, high = np.quantile(own, PROBS, method="lower"), np.quantile(own, PROBS, method="higher")
            for p, x, a, b in zip(PROBS, found[i], low, high, strict=True):
                at = (len(own) - 1) * p
                want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
                assert x == want or abs(x - want) <= 1e-12 * abs(want)


def test_quantiles_without_keys_or_rows(spark):
    df = table(spark, rows(2))
    assert q.quantiles(df, [], ["w"], [0.5], 50).collect() == q.quantiles(df, [], ["w"], [0.5]).collect()
    assert q.quantiles(df.limit(0), ["g"], ["v"], [0.5]).collect() == []
    n = Counter(r[1] for r in rows(2))
    assert stats.cluster_sizes(df, "y").first().median_size == np.median(list(n.values()))


def test_no_raw_percentile_in_plans(spark):
    df = table(spark, rows(3))
    for out in (stats.zonal(df, ["g"], "v", ["median", "mean"]), stats.outlier_flags(df, ["g"], "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan
