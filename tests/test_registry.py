import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import catalog, panel
from panelspark.plans import registry
from panelspark.sources import sinks


def test_callables_and_reducers(spark):
    def widest(v):
        return float(np.ptp(v)) if len(v) else 0.0

    df = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, None), (2, None)], "k int, v double")
    assert registry.resolve("math:sqrt")(4) == 2
    got = {r.k: r.v for r in registry.reduce_zones(df, ["k"], "v", widest).collect()}
    assert got == {1: 3.0, 2: 0.0}
    assert {r.k: r.v for r in registry.reduce_zones(df, ["k"], "v", "median").collect()} == {1: 2.5, 2: None}


def test_preprocessors():
    @registry.preprocessor("demo")
    class Demo(registry.Preprocessor):
        def targets(self):
            return ["a"]

        def process(self, target, tables):
            return tables[target]

    assert registry.PREPROCESSORS["demo"]().targets() == ["a"]


def test_old_stamps(spark):
    df = spark.createDataFrame([("2020-01-01 x",), (None,), ("FAILED: no",), ("downloading",), ("odd",)], "timestamp string")
    assert tuple(catalog.stamp_census(df).first()) == (5, 1, 2, 1, 1)
    assert [r[0] for r in df.select(catalog.modern_status(F.col("timestamp"))).collect()] == ["completed", "pending", "FAILED: no", "DOWNLOADING", "odd"]


def test_unmapped_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    first, second = spark.createDataFrame([("a", 1)], "label string, code int"), spark.createDataFrame([(1, 9)], "code int, id int")
    rows, odd = panel.two_hop(df, "name", first, second)
    assert rows.count() == 3 and [r[0] for r in odd.collect()] == ["b"]


def test_provenance(spark, tmp_path):
    sinks.write_provenance(spark, f"file://{tmp_path}", source="x", n=3)
    assert (tmp_path / "_provenance.yaml").read_text() == 'source: "x"\nn: 3\n'
