import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import catalog, panel, regression, spatial, stats
from panelspark.plans import formula, report, specs
from panelspark.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_full_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, 10), (None, 20)], "k int, a int")
    b = spark.createDataFrame([(None, 5), (2, 6)], "k int, b int")
    assert rows(panel.combine([a, b], ["k"])) == [(None, 20, 5), (1, 10, None), (2, None, 6)]


def test_static_table_spreads_unless_strict(spark):
    s = spark.createDataFrame([(1, 7)], "k int, s int")
    p = spark.createDataFrame([(1, 2000, 1), (1, 2001, 2)], "k int, year int, p int")
    assert len(rows(panel.combine([s, p], ["k", "year"]).filter("s = 7 and p is not null"))) == 2
    assert len(rows(panel.combine([s, p], ["k", "year"], "strict").filter("s = 7 and p is not null"))) == 0


def test_update_merge_keeps_rows(spark):
    base = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "k int, x int, y int")
    new = spark.createDataFrame([(1, 9), (1, 9), (3, 9)], "k int, x int")
    assert rows(panel.update_merge(base, new, ["k"]).select("k", "x", "y")) == [(1, 9, 1), (2, None, 2)]


def test_explode_years_edges(spark):
    s = spark.createDataFrame([(1, 2000, 1998), (2, 1990, None), (3, 2050, 2060)], "k int, a int, b int")
    got = rows(panel.explode_years(s, F.col("a"), F.col("b"), 1995, 1997).select("k", "year"))
    assert got == [(2, 1995), (2, 1996), (2, 1997)]


def test_first_match_takes_file_order(spark):
    pts = spark.createDataFrame([("a", 2001), ("a", 2009), ("b", 2001)], "k string, year int")
    sp = spark.createDataFrame([("a", 2000, 2002, 2, "x"), ("a", 2001, 2003, 1, "y")], "k string, s int, e int, o int, v string")
    assert rows(panel.first_match(pts, sp, "k", "year", "s", "e", "o", ["v"])) == [("a", 2001, "y"), ("a", 2009, None), ("b", 2001, None)]


def test_encode_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "l string")
    assert rows(panel.encode_labels(df, "l"), "code") == [(None, 0), ("a", 1), ("b", 2)]


def test_islands_with_nulls(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([None, None, "a", "a", None])], "k int, o int, l string")
    assert [r[1:] for r in rows(stats.islands(df, ["k"], "o", "l"), "run")] == [(1, None, 0, 1, 2), (2, "a", 2, 3, 2), (3, None, 4, 4, 1)]


def test_mode_ties_take_the_least(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 3.0), (1, 2.0), (2, None)], "k int, v double")
    assert rows(stats.modal(df, ["k"], "v")) == [(1, 2.0)]


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(11)] + [(1, None)], "k int, v double")
    got = [r[1] for r in rows(spatial.winsorize(df, ["k"], ["v"], 0.1), F.asc_nulls_first("v"))]
    assert got[0] is None and got[1] == 1.0 and got[-1] == 9.0


def test_polygon_boundary_and_concave(spark):
    ring = [{"x": x, "y": y} for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0), (0.0, 2.0)]]
    poly = spark.createDataFrame([("L", ring, 0)], "id string, ring array<struct<x:double,y:double>>, ordinal int")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.0), (3, 4.0, 2.0), (4, 0.0, 0.0), (5, 3.0, 3.0)], "k int, x double, y double")
    assert [r[0] for r in rows(spatial.point_in_polygon(pts, poly, "x", "y", 1.5))] == [1, 5]
    assert [r[0] for r in rows(spatial.point_in_polygon(pts, poly, "x", "y", 1.5, boundary=True))] == [1, 3, 4, 5]


def test_halo_and_resample(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (7, 8, 2.0), (20, 20, 3.0)], "r int, c int, v double")
    assert spatial.with_halo(df, "r", "c", 8, 1).count() == 1 + 4 + 1
    assert rows(spatial.resample(df, "r", "c", 8, ["v"], "sum")) == [(0, 0, 1.0), (0, 1, 2.0), (2, 2, 3.0)]
    assert rows(spatial.resample(df, "r", "c", 8, ["v"], "nearest"))[0] == (0, 0, 1.0)


def test_catalog_dedup_and_migration(spark):
    files = spark.createDataFrame([("u1", "A2000055"), ("u2", "x")], "source_url string, relative_path string")
    c = catalog.build(files)
    assert c.columns == [f.name for f in catalog.SCHEMA.fields]
    assert catalog.add(c, catalog.build(files)).count() == 2
    assert rows(c.select("year", "day_of_year", "status_category")) == [(0, 0, "pending"), (2000, 55, "pending")]


def test_sync_and_jobs_and_batches(spark):
    pairs = spark.createDataFrame([(3, 2, 1, 9), (None, 2, None, 1), (2, 2, 5, 5)], "local_files int, remote_files int, local_time int, remote_time int")
    assert [r["advice"] for r in catalog.sync_advice(pairs).collect()] == ["push", "pull", "in_sync"]
    jobs = spark.createDataFrame([("waiting", 2), ("waiting", 1), ("done", 0)], "status string, ordinal int")
    assert rows(catalog.next_jobs(jobs)) == [("waiting", 1)]
    assert catalog.next_jobs(jobs.union(spark.createDataFrame([("failed", 3)], jobs.schema))).count() == 0
    b = spark.createDataFrame([("g", i, s) for i, s in enumerate([4, 4, 4, 10, 1])], "g string, o int, s int")
    assert [r["batch"] for r in catalog.batches(b, "o", "s", 9, 2, "g").orderBy("o").collect()] == [0, 0, 1, 2, 3]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 1500
    unit, time = np.repeat(np.arange(150), 10), np.tile(np.arange(10), 150)
    z, e = rng.normal(size=n), rng.normal(size=n)
    x = 0.8 * z + 0.5 * e + unit % 7
    w = rng.normal(size=n)
    y = 2.0 * x + 0.5 * w + (unit % 7) * 1.5 + time * 0.3 + e
    rows_ = [(int(u), int(t), float(a), float(b), float(c), float(d)) for u, t, a, b, c, d in zip(unit, time, x, w, z, y, strict=True)]
    return spark.createDataFrame(rows_, "unit int, time int, x double, w double, z double, y double").cache(), (unit, time, x, w, z, y)


def test_ols_against_numpy(sample):
    df, (unit, time, x, w, z, y) = sample
    X = np.column_stack([np.ones_like(x), x, w])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    r = y - X @ b
    inv = np.linalg.inv(X.T @ X)
    f = regression.ols(df, "y", ["x", "w"])
    assert np.allclose(f.coef, b) and np.allclose(f.vcov, inv * (r @ r) / (len(y) - 3))
    hc1 = inv @ (X.T * r**2 @ X) @ inv * len(y) / (len(y) - 3)
    assert np.allclose(regression.ols(df, "y", ["x", "w"], se="HC1").vcov, hc1)

    def meat(g):
        s = np.array([X[g == k].T @ r[g == k] for k in np.unique(g)])
        n = len(s)
        return s.T @ s * n / (n - 1) * (len(y) - 1) / (len(y) - 3)

    two = inv @ (meat(unit) + meat(time) - meat(unit * 100 + time)) @ inv
    assert np.allclose(regression.ols(df, "y", ["x", "w"], ["unit", "time"]).vcov, two)
    assert f.joint_f() > 0 and 0 <= f.stats["f_pvalue"] <= 1


def test_tsls_against_numpy(sample):
    df, (unit, time, x, w, z, y) = sample
    X, Z = np.column_stack([np.ones_like(x), w, x]), np.column_stack([np.ones_like(x), w, z])
    P = Z @ np.linalg.solve(Z.T @ Z, Z.T @ X)
    b = np.linalg.solve(P.T @ X, P.T @ y)
    f = regression.tsls(df, "y", ["w"], ["x"], ["z"], ["unit"])
    assert np.allclose(f.coef, b)
    r, inv = y - X @ b, np.linalg.inv(P.T @ X)
    s = np.array([P[unit == k].T @ r[unit == k] for k in np.unique(unit)])
    v = inv @ (s.T @ s * len(s) / (len(s) - 1) * (len(y) - 1) / (len(y) - 3)) @ inv
    assert np.allclose(f.vcov, v) and f.first_stage["x"].stats["f"] > 10


def test_fixed_effects_agree(sample):
    df, (unit, time, x, w, z, y) = sample
    D = np.column_stack([x, w, *(unit == k for k in np.unique(unit)), *(time == k for k in np.unique(time)[1:])]).astype(float)
    b = np.linalg.lstsq(D, y, rcond=None)[0][:2]
    swept = regression.fe_ols(df, "y", ["x", "w"], ["unit", "time"])
    assert np.allclose(swept.coef, b, atol=1e-6)
    mundlak = regression.fe_ols(df, "y", ["x", "w"], ["unit", "time"], method="mundlak")
    assert np.allclose(mundlak.coef[1:3], b, atol=1e-6)  # equal on a balanced panel


def test_compression_keeps_the_gram_matrix(sample):
    df, _ = sample
    small = df.withColumn("x", F.bround("x", 0)).withColumn("w", F.bround("w", 0))
    c = regression.compress(small, "y", ["x", "w"])
    f = regression.ols(small, "y", ["x", "w"])
    g, n = regression.gram(c.withColumn("y", F.col("sum_y") / F.col("n")), ["Intercept", "x", "w", "y"], "n")
    assert np.allclose(np.linalg.solve(g[:3, :3], g[:3, 3]), f.coef) and n == f.n and c.count() < small.count()


def test_singletons_constants_bootstrap(spark, sample):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "a int, b int")
    assert regression.prune_singletons(df, ["a", "b"], iterative=True).count() == 0
    assert regression.constant_columns(df.withColumn("k", F.lit(1)), ["a", "k"]) == ["k"]
    b = regression.cluster_bootstrap(sample[0], "y", ["x"], "unit", 30, seed=1)
    f = regression.ols(sample[0], "y", ["x"], ["unit"])
    assert b.shape == (30, 2) and abs(b[:, 1].mean() - f.coef[1]) < 0.1


def test_formula(sample):
    f = formula.parse("y ~ log(x + 1) + a:b | fe1 + fe2^fe3 | q ~ z1 + z2 | c1 + c2")
    assert (f.y, f.x, f.effects, f.endog, f.instruments, f.cluster) == ("y", ["log(x + 1)", "a:b"], ["fe1", "fe2^fe3"], ["q"], ["z1", "z2"], ["c1", "c2"])
    assert formula.parse("y ~ x | 0 | unit").cluster == ["unit"]
    got = formula.fit(sample[0], "y ~ x + I(w**2) + (time == 3) | unit", "time >= 1")
    assert got.names == ["x", "I(w**2)", "(time == 3)"]


def test_specs():
    assert specs.workbook_where("a == 1 & b > 2 | c") == "a = 1 AND b > 2 OR c"
    assert specs.without_years("(year >= 1992) AND x = 1 AND year < 2000") == "x = 1"
    assert specs.temporal_extent("(year >= 1992) AND year > 1995 AND year < 2014") == (1996, 2013)
    assert specs.conjunction("a", "", None, "b") == "(a) AND (b)"
    assert specs.isin_where({"k": ["x", "y'z"], "n": 3}) == "k IN ('x', 'y''z') AND n = 3"
    assert specs.settings({"a": 1, "b": "x"}, {"a": "2", "b": ""}, {"c": "true"}) == {"a": 2, "b": "x", "c": True}
    assert specs.subset_name("EU.json", {"europe": 1}, {}, {"EU": "europe"}) == "europe"
    assert specs.memory_text("100GB", 0.5) == "50GB"


def test_report(spark, sample):
    fit = regression.ols(sample[0], "y", ["x", "w"])
    t = report.table(report.coefficient_rows(spark, {"m1": fit}, {"x": "Exposure"}), ["m1"])
    out = report.render(t, "latex")
    assert "Exposure" in out and "***" in out and "<table>" in report.render(t, "html")


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "ix int, iy int, v int")
    path = f"file://{tmp_path}/tiles"
    sinks.write_tiles(df, path)
    sinks.write_tiles(spark.createDataFrame([(0, 1, 9)], df.schema), path)
    assert rows(spark.read.parquet(path).select("v")) == [(1,), (9,)]
    tiles = spark.createDataFrame([(0, 0), (5, 5)], "ix int, iy int")
    assert rows(sinks.tiles_to_do(spark, tiles, path)) == [(5, 5)] and rows(sinks.tiles_to_do(spark, tiles, path, update=True)) == [(0, 0)]
    one = f"file://{tmp_path}/one"
    sinks.upsert_table(spark, one, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    sinks.upsert_table(spark, one, spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    assert rows(spark.read.parquet(one)) == [(1, "a"), (2, "c")]
    (tmp_path / "odd.csv").write_text("title\n\nid,name\n,\n1,x\n2,\n")
    assert rows(readers.headed_table(spark, f"file://{tmp_path}/odd.csv", ["id", "name"])) == [("1", "x"), ("2", None)]
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "p": "$HOME/x"}}')
    (tmp_path / "c.local.json").write_text('{"a": {"b": 2}}')
    got = readers.config(str(tmp_path / "c.json"))
    assert got["a"]["b"] == 2 and "$" not in got["a"]["p"]


def test_results_are_written(spark, sample, tmp_path):
    sinks.write_result(spark, regression.tsls(sample[0], "y", [], ["x"], ["z"]), f"file://{tmp_path}/r", model="m")
    import json

    got = json.loads((tmp_path / "r/results.json").read_text())
    assert got["first_stage"]["x"]["f_statistic"] > 10 and got["analysis_metadata"] == {"model": "m"}


def test_pruning_ends_at_the_fixed_point_of_a_long_chain(spark):
    # One end hangs on a block that stays; each round takes two rows off the other.
    chain = [(i, i + d) for i in range(53) for d in (0, 1)][1:]
    df = spark.createDataFrame([*chain, (0, 900), (900, 900), (900, 901), (901, 900), (901, 901)], "a int, b int").coalesce(1)
    assert sorted(tuple(r) for r in regression.prune_singletons(df, ["b", "a"]).collect()) == [(900, 900), (900, 901), (901, 900), (901, 901)]


def test_slow_panel_is_swept_to_the_end(spark):
    # Two years to a unit, so that the units link the years in a chain.
    rows = [(u, u + t, float((u * 7 + t * 3 + k * u + 2 * k) % 5), float((u * u + 4 * t + k * u * t + 3 * k) % 11)) for u in range(4) for t in (0, 1) for k in (0, 1)]
    df = spark.createDataFrame(rows, "unit int, year int, x double, y double").coalesce(1)
    wide = np.array([[x, *(float(u == k) for k in range(4)), *(float(t == k) for k in range(1, 5))] for u, t, x, _ in rows])
    want = np.linalg.lstsq(wide, np.array([r[3] for r in rows]), rcond=None)[0][0]
    with pytest.raises(RuntimeError, match="2 rounds"):
        regression.fe_ols(df, "y", ["x"], ["unit", "year"], max_rounds=2)
    assert abs(regression.fe_ols(df, "y", ["x"], ["unit", "year"]).coef[0] - want) < 1e-6


def test_spatial_extent_labels():
    at = lambda x: specs.spatial_extent(x, "1992-2013")
    assert at(None) == at("") == at("nan") == at("World") == at("[world]") == at(float("nan")) == "full_sample"
    assert at("HDI > LOW") == "HDI_ME_HI_VH_1991" and at("wb_upper_middle") == "WB_UM_1991" and at("HDI [V. High]") == "HDI_VH_1991"
    assert at("HDI_GTLO_1995") == "HDI_ME_HI_VH_1995" and at("WB_LM_1995") == "WB_LM_1995" and at("AF") == "AF"
    with pytest.raises(ValueError):
        at("HDI odd")


def test_model_specs_give_fits(spark):
    effects = {"0": ("NO", []), "country & year": ("CY", ["country", "year"])}
    clusters = {"adm1": ("ADM1", "adm1"), "country": ("Country", "country")}
    sources = {"1km": ("one.parquet", "1992-2013"), "50km": ("fifty.parquet", "1990-2020")}
    model = {"model_name": " m1 ", "dependent": "y", "independent": "x + log(z + 1)", "fixed_effects": "0", "data_source": "1km", "instruments": "0", "query": "(a == 1) & (year >= 1995)"}
    got = specs.model_spec(model, effects, clusters, sources, {"50km": "country"})
    assert got["formula"] == "y ~ x + log(z + 1)" and got["cluster"] is None and got["source"] == "one.parquet"
    assert got["where"] == "((year >= 1992) AND (year <= 2013)) AND ((a = 1))" and got["variant_path"] == ["m1", "NO", "1km", "1992-2013", "full_sample", ""]
    got = specs.model_spec({**model, "instruments": "x ~ w"}, effects, clusters, sources, {"50km": "country"}, resolution="50km", fixed_effects="country & year", spatial_extent="HDI LOW", temporal_extent="2000-2005")
    assert got["formula"] == "y ~ x + log(z + 1) | country + year | x ~ w" and got["cluster"] == "country" and got["spatial_extent"] == "HDI_LO_1999"
    with pytest.raises(ValueError):
        specs.model_spec({**model, "fixed_effects": "odd"}, effects, clusters, sources)


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "year int, PM25 int, gwrpm25 int")
    assert panel.resolve_column(df, ["gwrpm25", "pm25"]) == "gwrpm25" and panel.resolve_column(df, ["pm25"]) == "PM25"
    assert panel.resolve_column(df, ["no"]) is None and panel.resolve_column(df.select("year", "PM25"), ["no"], ("year",)) == "PM25"


def test_means_come_back_to_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    assert rows(stats.group_means(df, ["g"], ["v"]).select("v", "v_mean_g")) == [(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)]
    assert rows(stats.within(df, ["g"], ["v"]).select("v_within")) == [(-1.0,), (0.0,), (1.0,)]


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = 2 * x + rng.normal(size=500) * 1e-3
    plain = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    far = plain.select((F.col("x") + 1e8).alias("x"), (F.col("y") + 1e8).alias("y"))
    a, b = regression.ols(plain, "y", ["x"], se="HC1"), regression.ols(far, "y", ["x"], se="HC1")
    assert abs(a.coef[1] - b.coef[1]) < 1e-5 and abs(a.stats["rss"] / b.stats["rss"] - 1) < 1e-3 and abs(a.se[1] / b.se[1] - 1) < 1e-3
    assert abs(a.coef[0] + 1e8 - 1e8 * a.coef[1] - b.coef[0]) / 1e8 < 1e-5 and a.top(1)[0][0] == "x"


def test_long_chains_of_singletons(spark):
    chain = spark.createDataFrame([(i, t) for i in range(4) for t in (i, i + 1)], "unit int, year int")
    assert regression.prune_singletons(chain, ["unit", "year"]).count() == 0
    assert 0 < regression.prune_singletons(chain, ["unit", "year"], iterative=False).count() < 8


def test_unfinished_sweeps_are_an_error(spark):
    df = spark.createDataFrame([(i, t, float(i * t % 5)) for i in range(4) for t in range(4) if (i + t) % 3], "unit int, year int, x double")
    with pytest.raises(RuntimeError):
        regression.demean(df, ["unit", "year"], ["x"], max_rounds=1)
    out = regression.demean(df, ["unit", "year"], ["x"])
    for e in ("unit", "year"):
        assert max(abs(r[1]) for r in out.groupBy(e).agg(F.avg("x")).collect()) < 1e-7


def test_constant_regressors_are_left_out(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 + (i % 3), 7.0) for i in range(20)], "x double, y double, c double")
    assert formula.fit(df, "y ~ x + c", drop_constants=True).names == ["Intercept", "x"]
    with pytest.raises(ValueError, match="c"):
        formula.fit(df, "y ~ x + c")


def test_buffer_counts_pair_places_not_rows(spark, monkeypatch):
    """1,000 cells at four places (and one at none), 600 sites at three: places alone are paired; a key twice adds up."""
    cells = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit("own").alias("z"))
    cells = cells.union(spark.createDataFrame([(1000, None, 0.5, "own"), (3, 0.0, 0.5, "own")], cells.schema))
    sites = spark.range(600).select((F.col("id") % 3 * 10).cast("double").alias("sx"), F.lit(0.5).alias("sy"))
    met, plain = [], spatial.neighbours

    def counted(left, right, *rest):
        met.append((left.filter("x is not null").count(), right.count()))
        return plain(left, right, *rest)

    monkeypatch.setattr(spatial, "neighbours", counted)
    got = spatial.buffer_counts(cells, sites, ("x", "y"), ("sx", "sy"), 2.0, "k")
    assert met == [(4, 3)] and got.columns == ["k", "x", "y", "z", "n_sites"]
    want = {k: 0 if k % 4 == 3 or k == 1000 else 200 for k in range(1001)} | {3: 200}
    assert sorted((r.k, r.n_sites) for r in got.collect()) == sorted([*want.items(), (3, 200)])


@pytest.mark.parametrize("name", ["q_buffer_count", "q_buffer_count_all"])
def test_buffer_query_has_a_row_for_each_order(spark, sf, tmp_path, name):
    from panelspark.queries import QUERIES

    spark.read.parquet(f"{sf}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet").limit(20)
    orders.union(orders).write.parquet(f"{tmp_path}/orders.parquet")
    once = {r.k: r.n_sites for r in QUERIES[name](spark, sf).collect()}
    twice = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(twice) == 20 and all(r.n_sites == 2 * once[r.k] for r in twice)
