"""Fixed effects against dummies in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import storage
from panelspark.operators import absorb, graph, regression
from panelspark.plans import formula


def dummies(*effects):
    return np.column_stack([(np.array(e)[:, None] == np.array(sorted(set(e)))).astype(float) for e in effects])


def by_dummies(y, x, *effects):
    """Slopes, residual sum of squares and rank of regressors with dummies."""
    d = np.column_stack([x, dummies(*effects)])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    return b[: np.shape(x)[1]], float(((y - d @ b) ** 2).sum()), int(np.linalg.matrix_rank(d))


def panel(spark, seed, link, three=False):
    """Units of two rows in a chain of years: weakly connected; `link` False parts it in two."""
    rng = np.random.default_rng(seed)
    unit = np.repeat(np.arange(30), 3)
    year = unit // 4 + rng.integers(0, 2, 90) + np.where((unit >= 15) & (not link), 50, 0)
    x, w = rng.normal(size=90) + year * 0.3, rng.normal(size=90) + unit * 0.1
    y = 2 * x - w + unit * 0.5 + year * 1.5 + rng.normal(size=90)
    group = rng.integers(0, 5, 90)
    df = spark.createDataFrame([(int(a), f"y{b}", int(g), *map(float, v)) for a, b, g, *v in zip(unit, year, group, y, x, w, strict=True)], "unit int, year string, g int, y double, x double, w double")
    return df, y, np.column_stack([x, w]), [unit, year] + ([group] if three else [])


@pytest.mark.parametrize(("link", "three", "small"), [(True, False, True), (False, False, True), (True, True, True), (True, False, False)])
def test_effects_as_dummies(spark, link, three, small, monkeypatch):
    if not small:
        monkeypatch.setattr(storage, "SMALL_CELLS", 0)
    df, y, x, effects = panel(spark, 1, link, three)
    want, rss, rank = by_dummies(y, x, *effects)
    names = ["unit", "year", "g"][: len(effects)]
    got = regression.fe_ols(df, "y", ["x", "w"], names, tolerance=1e-10)
    assert np.allclose(got.coef, want, atol=1e-8) and abs(got.stats["rss"] / rss - 1) < 1e-8
    assert got.df == len(y) - rank and absorb.absorbed_by(df, names) == rank - 2
    plan = absorb.demean(df, names, ["y"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_demeaning_is_a_projection(spark):
    df, *_ = panel(spark, 2, True)
    odd = df.union(df.limit(4).withColumns({"unit": F.lit(None).cast("int"), "year": F.lit("y3")})).union(df.limit(2).withColumn("x", F.lit(None).cast("double"))).withColumn("x", F.col("x") * 1e6 + 1e9)
    out = absorb.demean(odd, ["unit", "year"], ["x", "y"]).cache()
    assert out.columns == odd.columns and out.count() == 96 and out.filter("x is null").count() == 2
    for e in ("unit", "year"):
        assert max(abs(r[1]) for r in out.dropna(subset=["x"]).groupBy(e).agg(F.avg("x")).collect()) < 1e-3
    one = absorb.demean(df, ["unit"], ["y"]).groupBy("unit").agg(F.avg("y")).collect()
    assert max(abs(r[1]) for r in one) < 1e-12
    assert absorb.demean(df.limit(0), ["unit", "year"], ["y"]).collect() == []


def test_mixed_and_auto(spark):
    df, y, x, (unit, year) = panel(spark, 3, True)
    means = np.column_stack([x] + [np.array([x[unit == u, j].mean() for u in unit]) for j in range(2)])
    want, _, rank = by_dummies(y, means, year)
    for options in ({"method": "auto"}, {"method": "mixed", "means": ["unit"]}):
        got = regression.fe_ols(df, "y", ["x", "w"], ["year", "unit"], **options)
        assert np.allclose(got.coef, want, atol=1e-7) and got.df == len(y) - rank
    with pytest.raises(ValueError):
        regression.fe_ols(df, "y", ["x"], ["year"], method="odd")


def test_a_fit_prunes_and_tells_constants(spark):
    df, y, x, (unit, year) = panel(spark, 4, True)
    lone = df.union(df.limit(1).withColumns({"unit": F.lit(999), "y": F.lit(1e6)}))
    want = regression.fe_ols(df, "y", ["x", "w"], ["unit", "year"])
    got = formula.fit(lone, "y ~ x + w | unit + year")
    assert got.n == len(y) and np.allclose(got.coef, want.coef, atol=1e-7)
    assert formula.fit(lone, "y ~ x + w | unit + year", singletons=None).n == len(y) + 1
    # Constant on the complete rows only, and constant within units.
    odd = df.withColumn("c", F.when(F.col("unit") < 29, 3.0)).withColumn("c", F.when(F.col("unit") == 28, 9.0).otherwise(F.col("c"))).withColumn("w", F.when(F.col("unit") != 28, F.col("w")))
    with pytest.raises(ValueError, match="c"):
        formula.fit(odd, "y ~ x + w + c")
    assert formula.fit(odd, "y ~ x + w + c", drop_constants=True).names == ["Intercept", "x", "w"]
    assert formula.fit(df.withColumn("u", F.col("unit") * 2.0), "y ~ x + u | unit + year", drop_constants=True).names == ["x"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(7000, 7000)] + [(5, 3), (3, 5), (None, 4)]
    got = {r.node: r.label for r in graph.connected(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000), 7000: 7000}
    rng = np.random.default_rng(0)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (90, 2))]
    parent = {n: n for e in edges for n in e}
    for _ in range(120):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.label for r in graph.connected(spark.createDataFrame(edges, "u string, v string")).collect()} == parent
    assert graph.connected(spark.createDataFrame([], "u int, v int")).collect() == []
