import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.__main__ import main
from panelspark.operators import panel, regression
from panelspark.plans import jobs
from panelspark.sources import readers, tables


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    at = f"file://{root}"
    cells = spark.range(64).select((F.col("id") / 8).cast("long").alias("row"), (F.col("id") % 8).alias("col"))
    years = cells.crossJoin(spark.range(2000, 2004).select(F.col("id").alias("year")))
    values = years.withColumn("Lights", (F.col("row") * 3 + F.col("col") * F.col("year") % 7).cast("double")).withColumn("t", F.make_date("year", F.lit(5), F.lit(1))).drop("year")
    values.write.parquet(f"{at}/lights")
    cells.withColumn("height", (F.col("row") - F.col("col")).cast("double")).write.parquet(f"{at}/height")
    config = {
        "assemble": {"main": {"out": f"{at}/panel", "grid": {"lat0": 0, "lon0": 0, "lat_step": 1, "lon_step": 1, "n_rows": 8, "n_cols": 8, "tile": 4}, "pad": 1,
            "sources": [{"name": "ntl", "path": f"{at}/lights", "candidates": ["lights"], "time": "t", "years": [2001, 2003], "winsor": 0.1}, {"name": "dem", "path": f"{at}/height", "values": ["height"]}],
            "demean": {"effects": ["pixel_id", "year"], "values": ["ntl_Lights"]}}},
        "analysis": {"models": f"{at}/models.csv", "results": f"{at}/results", "effects": {"0": ["NO", []], "cell": ["CELL", ["pixel_id"]]}, "clusters": {"cell": ["Cell", "pixel_id"]},
            "sources": {"1km": [f"{at}/flat", "2001-2003"]}},
    }
    (root / "c.json").write_text(json.dumps(config))
    (root / "models.csv").write_text("order,model_name,dependent,independent,fixed_effects,data_source,clustering,instruments,query\n2,two,ntl_Lights,trend,cell,1km,cell,0,\n1,one,ntl_Lights,dem_height + trend,0,1km,,0,year >= 2002\nx,skipped,a,b,0,1km,,0,\n")
    return at, str(root / "c.json"), config


def test_panels_by_command(spark, place, capsys):
    at, path, config = place
    main(["assemble", "create", "--config", path, "--source", "main"])
    assert "192 rows" in capsys.readouterr().out
    made = tables.read(spark, f"{at}/panel")
    assert made.columns == ["pixel_id", "year", "ntl_Lights", "dem_height"] and made.filter("dem_height IS NULL OR year IS NULL").count() == 0
    main(["assemble", "update", "--config", path, "--source", "main", "--datasource", "dem"])
    assert tables.manifest(spark, f"{at}/panel")["version"] == 1
    assert sorted(map(tuple, tables.read(spark, f"{at}/panel").select(*made.columns).collect())) == sorted(map(tuple, tables.read(spark, f"{at}/panel", 0).collect()))
    main(["assemble", "demean", "--config", path, "--source", "main"])
    out = tables.read(spark, f"{at}/panel_demeaned")
    assert max(abs(r[1]) for r in out.groupBy("year").agg(F.avg("ntl_Lights")).collect()) < 1e-7
    with pytest.raises(ValueError, match="odd"):
        jobs.create_panel(spark, config["assemble"]["main"], ["odd"])
    with pytest.raises(ValueError):
        readers.resolve(made, ["nothing"])


def test_models_by_command(spark, place, capsys):
    at, path, config = place
    flat = jobs.create_panel(spark, config["assemble"]["main"]).withColumn("trend", F.col("year") * F.col("dem_height") % 5)
    flat.write.parquet(f"{at}/flat")
    main(["analysis", "run", "--config", path])
    said = capsys.readouterr().out.splitlines()
    assert [x.split(":")[0] for x in said] == ["one", "two"]
    main(["analysis", "run", "--config", path])  # nothing is missing
    assert capsys.readouterr().out == ""
    main(["analysis", "run", "--config", path, "--model", "two", "--again"])
    main(["analysis", "summary", "--config", path])
    assert "two" in capsys.readouterr().out
    assert [r.n_results for r in jobs.summary(spark, config["analysis"]).collect()] == [1, 2]
    with pytest.raises(ValueError, match="three"):
        jobs.run_models(spark, config["analysis"], ["three"])
    old = jobs.cleanup(spark, config["analysis"], dry_run=True)
    assert len(old) == 1 and "/two/" in old[0]
    main(["analysis", "cleanup", "--config", path])
    assert jobs.cleanup(spark, config["analysis"]) == []
    main(["analysis", "tables", "--config", path, "--formats", "text", "html"])
    assert "trend" in capsys.readouterr().out
    want = regression.fe_ols(flat, "ntl_Lights", ["trend"], ["pixel_id"], cluster=["pixel_id"])
    two = next(r for r in jobs.newest(spark, f"{at}/results").collect() if r.analysis_metadata.model_name == "two")
    assert abs(two.coefficients.estimates[0] - want.coef[0]) < 1e-9 and abs(two.coefficients.std_errors[0] - want.se[0]) < 1e-9


def test_results_move_with_their_labels(spark, place):
    at, path, config = place
    own = json.loads(json.dumps(config["analysis"]))
    before = jobs.results(spark, own["results"]).count()
    assert jobs.relabelled(spark, own) == []
    own["effects"]["cell"][0] = "PIX"  # a label has another name today
    assert len(jobs.relabel(spark, own, dry_run=True)) == 1
    ((old, new),) = jobs.relabel(spark, own)
    assert "/CELL/" in old and "/PIX/" in new and jobs.relabelled(spark, own) == []
    assert jobs.results(spark, own["results"]).count() == before
    own["effects"] = {"0": ["NO", []]}
    with pytest.raises(ValueError):
        jobs.relabelled(spark, own)


def test_seeds_maps_and_bootstrap(spark):
    seed = spark.createDataFrame([(1, 2000), (1, 2000), (2, 2000)], "id int, year int")
    t = spark.createDataFrame([(1, 2000, 5.0), (3, 2001, 6.0)], "id int, year int, v double")
    assert sorted(map(tuple, panel.seeded(seed, [t], ["id", "year"]).collect())) == [(1, 2000, 5.0), (2, 2000, 0.0), (3, 2001, 6.0)]
    with pytest.raises(ValueError):
        panel.seeded(seed, [t.drop("year")], ["id", "year"])
    new = spark.createDataFrame([(1, {"a": 2}, 2), (1, {"a": 1}, 1)], "id int, m map<string,int>, o int")
    assert panel.update_merge(seed, new.drop("o"), ["id"]).filter("id = 1").first().m == {"a": 1}
    assert panel.update_merge(seed, new, ["id"], -F.col("o")).filter("id = 1").first().m == {"a": 2}
    rng = np.random.default_rng(0)
    far = spark.createDataFrame([(int(i % 20), float(x), float(3 * x + rng.normal() * 1e-3)) for i, x in enumerate(rng.normal(size=400))], "g int, x double, y double").withColumns({"x": F.col("x") + 1e8, "y": F.col("y") + 3e8})
    assert abs(regression.cluster_bootstrap(far, "y", ["x"], "g", 20)[:, 1] - 3).max() < 1e-2
