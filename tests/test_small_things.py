import pytest
from pyspark.sql import functions as F

from panelspark.functions import text
from panelspark.functions.grid import GridSpec
from panelspark.operators import catalog
from panelspark.plans import registry, specs
from panelspark.sources import readers, sinks


def test_tiles_that_cannot_be_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 2, 3)], "ix int, iy int, v int")
    sinks.write_tiles(df, path)
    (tmp_path / "t/ix=1/iy=2/broken.parquet").write_bytes(b"PAR1 and no more")
    (tmp_path / "t/ix=5/iy=6").mkdir(parents=True)
    (tmp_path / "t/ix=5/iy=6/x.parquet").write_bytes(b"junk")
    got = {(r.ix, r.iy): (r.n_rows, r.n_unread, r.valid) for r in sinks.valid_tiles(spark, path).collect()}
    assert got == {(0, 0): (2, 0, True), (1, 2): (1, 1, False), (5, 6): (0, 1, False)}


def test_metadata_and_sources(spark, tmp_path):
    meta = spark.createDataFrame([("modis", "lst", 0.02, 0.0, 0), ("modis", "qc", None, None, None), ("ntl", "lst", 1.0, 5.0, 255)], "dataset string, variable string, scale double, offset double, fill int")
    assert readers.packing_of(meta, "modis") == {"lst": (0.02, 0.0, 0), "qc": (1.0, 0.0, None)}
    assert sorted(readers.variable_info(meta, variable="lst")) == ["modis.lst", "ntl.lst"]
    assert readers.variable_info(meta, "ntl", "lst") == {"ntl.lst": {"scale": 1.0, "offset": 5.0, "fill": 255}}
    with pytest.raises(KeyError):
        readers.variable_info(meta, "odd")
    for year in (1999, 2001):
        spark.createDataFrame([(0, 0, year * 1.0, 1)], "row int, col int, a double, b int").coalesce(1).write.parquet(f"file://{tmp_path}/x_{year}_v2.parquet")
    source = registry.create_source({"type": "parquet", "path": f"file://{tmp_path}", "tables": ["x_1999_v2"]})
    assert source.names() == ["x_1999_v2"] and source.table(spark, "x_1999_v2").count() == 1
    with pytest.raises(KeyError):
        registry.create_source({"type": "odd"})
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}")
    got = registry.with_years(files, lambda p: text.bounded_year(F.regexp_extract(p, r"/(x_[^/]*)/", 1), 1992, 2030), lambda df: df.withColumn("a", F.col("a") + 1), lambda names: [n for n in names if n == "a"], [2001])
    assert [tuple(r) for r in got.collect()] == [(0, 0, 2001, 2002.0)] and got.columns == ["row", "col", "year", "a"]


def test_years_memory_and_choices(spark):
    names = ["v1999b_2005.nc", "x20011231/1995.tif", "DMSP2003", "0042_1850", "a-2010-b2011"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.bounded_year(F.col("n"), 1990, 2040)).collect()] == [1999, 2001, 2003, None, 2010]
    assert [r[0] for r in df.select(text.bounded_year(F.col("n"), 1990, 2040, delimited=True)).collect()] == [2005, 1995, 2003, None, 2010]
    assert specs.partition_for("112GB") == "normal" and specs.partition_for("256 GB") == "large" and specs.partition_for("1TB", "own") == "own" and specs.partition_for("0.25TB") == "large"
    with pytest.raises(ValueError):
        specs.memory_gb("12")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "o int, id string")
    assert [catalog.pick(rows, "id", w, "o").first().o for w in ("b", "z", None)] == [2, 1, 1]
    pairs = spark.createDataFrame([(True, True), (True, None), (False, True), (None, None)], "local_exists boolean, remote_exists boolean")
    assert [r.advice for r in catalog.presence_advice(pairs).collect()] == ["compare", "push", "pull", "none"]


def test_grids_together():
    a, b = GridSpec(10.0, 0.0, -0.5, 0.5, 20, 10), GridSpec(8.0, 3.0, -0.5, 0.5, 30, 10)
    both, common = a.union(b), a.intersect(b)
    assert (both.lat0, both.lon0, both.n_rows, both.n_cols) == (10.0, 0.0, 34, 16) and b.union(a) == both
    assert (common.lat0, common.lon0, common.n_rows, common.n_cols) == (8.0, 3.0, 16, 4) and b.intersect(a) == common
    assert a.crop(-2, 8, 5, 5) == GridSpec(10.0, 4.0, -0.5, 0.5, 3, 2) and a.pad(3).crop(3, 3, 20, 10) == a
    for odd in (GridSpec(10.0, 0.0, -0.25, 0.5, 2, 2), GridSpec(10.1, 0.0, -0.5, 0.5, 2, 2), GridSpec(-90.0, 0.0, -0.5, 0.5, 2, 2)):
        with pytest.raises(ValueError):
            a.intersect(odd)
