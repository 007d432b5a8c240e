import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.grid import GridSpec
from panelspark.operators import warp
from panelspark.sources import files, tables

SCHEMA = "k int, v string"


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_are_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    assert tables.upsert(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), path, "k") == 0
    assert tables.upsert(spark.createDataFrame([(2, "c"), (3, "d")], SCHEMA), path, "k") == 1
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert held(tables.read(spark, path)) == want and held(tables.read(spark, path, 0)) == [(1, "a"), (2, "b")]

    # Killed after the part is written, and killed before the version has its name.
    with monkeypatch.context() as m:
        m.setattr(tables, "_commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            tables.replace(spark.createDataFrame([(9, "x")], SCHEMA), path)
    files.write_text(spark, f"{path}/_versions/.half.tmp", '{"version": 2')
    assert held(tables.read(spark, path)) == want
    assert len(files.names(spark, f"{path}/parts")) == 3
    assert tables.recover(spark, path) == []  # too young to be given up
    assert len(tables.recover(spark, path, older_than=0.0)) == 1
    assert held(tables.read(spark, path)) == want and held(tables.read(spark, path, 0)) == [(1, "a"), (2, "b")]
    tables.recover(spark, path, keep=1, older_than=0.0)
    assert held(tables.read(spark, path)) == want and len(files.names(spark, f"{path}/parts")) == 1

    # Two writers from one version: the second is told.
    base = tables.manifest(spark, path)
    tables.replace(spark.createDataFrame([(5, "e")], SCHEMA), path, base)
    with pytest.raises(tables.Conflict):
        tables.replace(spark.createDataFrame([(6, "f")], SCHEMA), path, base)
    assert held(tables.read(spark, path)) == [(5, "e")]
    assert not files.commit_text(spark, f"{path}/_versions", 2, "{}")


def test_a_skeleton_is_filled_by_region(spark, tmp_path):
    path = f"file://{tmp_path}/grid"
    tables.skeleton(spark, path, {"year": (2000, 2001), "row": (0, 1), "col": (0, 1)}, ["v"])
    assert tables.read_grid(spark, path).filter("v IS NULL").count() == 8
    part = lambda y, v: spark.createDataFrame([(y, 0, 0, v), (y, 1, 1, v + 1)], "year int, row int, col int, v double")
    base = tables.manifest(spark, path)
    tables.fill_region(part(2000, 1.0), path, year=2000, ix=0)
    tables.fill_region(part(2001, 5.0), path, year=2001, ix=0)
    tables.fill_region(part(2000, 7.0), path, ix=0, year=2000)  # again: in its own place
    assert tables.regions(spark, path) == ["ix=0/year=2000", "ix=0/year=2001"]
    got = {tuple(r)[:3]: r.v for r in tables.read_grid(spark, path).collect()}
    assert len(got) == 8 and got[2000, 0, 0] == 7.0 and got[2001, 1, 1] == 6.0 and sum(v is None for v in got.values()) == 4
    # Regions filled at the same time do not get in one another's way; the same region does.
    schema = base["schema"]
    with pytest.raises(tables.Conflict):
        tables._commit(spark, path, base, {"ix=0/year=2000": "parts/x"}, schema, {})
    tables._commit(spark, path, base, {"ix=9/year=2000": tables._write(tables.read(spark, path).limit(0), path)}, schema, {})
    assert len(tables.regions(spark, path)) == 3 and tables.read(spark, path).count() == 4


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "spline"])
def test_warp_by_hand(spark, method):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(9, 12))
    data[3, 4] = np.nan
    rows = [(r, c, float(data[r, c]) if rng.random() > 0.05 else None) for r in range(9) for c in range(12) if (r, c) != (6, 6)]
    have = {(r, c): v for r, c, v in rows if v is not None and not np.isnan(v)}
    source, target = GridSpec(10.0, 0.0, -1.0, 2.0, 9, 12), GridSpec(11.3, -1.7, -0.7, 1.3, 16, 21)
    kernels = {"bilinear": (1, lambda d: max(0, 1 - d)), "cubic": (2, lambda d: 1.5 * d**3 - 2.5 * d * d + 1 if d < 1 else -0.5 * d**3 + 2.5 * d * d - 4 * d + 2 if d < 2 else 0), "spline": (2, lambda d: (4 - 6 * d * d + 3 * d**3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0)}
    want = {}
    for i in range(16):
        for j in range(21):
            lat, lon = 11.3 - 0.7 * i, -1.7 + 1.3 * j
            y, x = (lat + 0.1 - 10.0) / -1.0, (lon - 0.2) / 2.0  # the source lies 0.1 north and 0.2 west of itself
            if method == "nearest":
                at = {(int(np.floor(y + 0.5)), int(np.floor(x + 0.5))): 1.0}
            else:
                reach, k = kernels[method]
                r0, c0 = int(np.floor(y)), int(np.floor(x))
                at = {(r, c): k(abs(y - r)) * k(abs(x - c)) for r in range(r0 + 1 - reach, r0 + reach + 1) for c in range(c0 + 1 - reach, c0 + reach + 1)}
            total = sum(w for p, w in at.items() if p in have)
            if abs(total) > 1e-9:
                want[i, j] = sum(w * have[p] for p, w in at.items() if p in have) / total
    df = spark.createDataFrame(rows, "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in warp.warp(df, source, target, ["v"], method, lambda lat, lon: (lat + 0.1, lon - 0.2)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        warp.warp(df, source, target, ["v"], "odd")
    assert warp.warp(df.withColumn("y", F.lit(1)), source, target, ["v"], by=("y",)).columns == ["y", "row", "col", "v"]
