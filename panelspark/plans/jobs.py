"""What the command line does: panels from a configuration, models from a sheet, their results."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.grid import GridSpec
from panelspark.operators.absorb import demean
from panelspark.plans import formula, report, specs
from panelspark.plans.assemble import Assembly, Source, assemble, update
from panelspark.sources import files, readers, sinks, tables


def assembly(spark: SparkSession, config: dict[str, Any]) -> Assembly:
    """The plan of a panel: `grid` (the fields of a GridSpec), `sources` (name, path, values or candidates, and a Source's other fields), `land`, `index`, `derived`, `policy`, `pad`."""
    made = []
    for s in config["sources"]:
        table = readers.parquet(spark, s["path"])
        if s.get("where"):
            table = table.filter(s["where"])
        values = s.get("values") or [readers.resolve(table, s["candidates"], ("row", "col", "year", s.get("time", "year")))]
        table = readers.dataset(table, values, ["row", "col"], s.get("time"), tuple(s["years"]) if s.get("years") else None)
        made.append(Source(s["name"], table, values, **{k: s[k] for k in ("factor", "resampling", "winsor", "fill") if k in s}))
    land = readers.parquet(spark, config["land"]) if config.get("land") else None
    return Assembly(GridSpec(**config["grid"]), made, land, **{k: config[k] for k in ("index", "derived", "policy", "pad") if k in config})


def create_panel(spark: SparkSession, config: dict[str, Any], only: list[str] | None = None) -> DataFrame:
    """Assembles a panel (of the sources in `only`) and commits it to the configuration's `out`."""
    panel = assemble(assembly(spark, config), only)
    tables.replace(panel, config["out"])
    sinks.write_provenance(spark, config["out"], sources=[s["name"] for s in config["sources"] if not only or s["name"] in only], made=time.strftime("%Y-%m-%dT%H:%M:%S"))
    return tables.read(spark, config["out"])


def update_panel(spark: SparkSession, config: dict[str, Any], name: str) -> DataFrame:
    """Makes one source's columns anew in a panel that is there."""
    base = tables.manifest(spark, config["out"])
    tables.replace(update(tables.read(spark, config["out"]), assembly(spark, config), name), config["out"], base)
    return tables.read(spark, config["out"])


def demean_panel(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Takes the configuration's `demean` effects out of its `demean` values and commits that beside the panel."""
    own, out = config["demean"], f"{config['out']}_demeaned"
    panel = tables.read(spark, config["out"])
    tables.replace(demean(panel.dropna(subset=own["values"]), own["effects"], own["values"]), out)
    return tables.read(spark, out)


def model_specs(spark: SparkSession, config: dict[str, Any], wanted: list[str] | None = None) -> list[dict[str, Any]]:
    """Rows of the model sheet (a CSV: a row a model), in their order, as specs; an unknown name is an error."""
    rows = [r.asDict() for r in specs.model_order(spark.read.csv(config["models"], header=True)).collect()]
    missing = set(wanted or []) - {str(r["model_name"]).strip() for r in rows}
    if missing:
        raise ValueError(f"no models {sorted(missing)}")
    pairs = lambda name: {k: tuple(v) for k, v in config[name].items()}
    made = [specs.model_spec(r, pairs("effects"), pairs("clusters"), pairs("sources"), config.get("default_cluster")) for r in rows]
    return [s for s in made if not wanted or s["model_name"] in wanted]


def _variant(spec: dict[str, Any]) -> str:
    return "/".join(x.replace("/", "-") or "none" for x in map(str, spec["variant_path"]))


def run_models(spark: SparkSession, config: dict[str, Any], wanted: list[str] | None = None, again: bool = False) -> dict[str, str]:
    """Fits the models that have no result yet (all of `wanted` with `again`); the folder of each one's result."""
    settings = specs.settings({"fe_method": "demean", "singletons": "iterative", "drop_constants": False}, config.get("settings", {}), {})
    out = {}
    for spec in model_specs(spark, config, wanted):
        place = f"{config['results']}/{_variant(spec)}"
        if files.names(spark, place) and not again:
            continue
        text = spec["formula"] if not spec["cluster"] else f"{spec['formula']} | {spec['cluster']}" if "|" in spec["formula"] else f"{spec['formula']} | 0 | {spec['cluster']}"
        table = spark.read.parquet(spec["source"])
        extents = config.get("extents", {})
        if spec["spatial_extent"] in extents:
            table = table.filter(extents[spec["spatial_extent"]])
        fit = formula.fit(table, text, spec["where"] or None, **settings)
        out[spec["model_name"]] = f"{place}/{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 10**9:09d}"
        sinks.write_result(spark, fit, out[spec["model_name"]], **{k: v for k, v in spec.items() if k != "variant_path"})
    return out


def results(spark: SparkSession, place: str) -> DataFrame:
    """All results below a folder: `path`, `variant`, `stamp` and what results.json says."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "results.json").option("multiLine", "true").json(place)
    path = F.regexp_replace(F.input_file_name(), r"/results\.json$", "")
    return rows.withColumn("path", path).withColumn("variant", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("stamp", F.regexp_extract("path", r"([^/]+)$", 1))


def newest(spark: SparkSession, place: str) -> DataFrame:
    return specs.newest_results(results(spark, place), ["variant"], "stamp")


def coefficient_rows(found: DataFrame) -> DataFrame:
    """The coefficients of results as the rows that `report.table` takes."""
    c = F.col("coefficients")
    zipped = F.arrays_zip(c["names"].alias("label"), c["estimates"].alias("estimate"), c["std_errors"].alias("std_error"), c["p_values"].alias("p"))
    return found.select(F.col("analysis_metadata.model_name").alias("model"), F.lit("").alias("stage"), F.posexplode(zipped).alias("place", "x")).select("model", "stage", "place", "x.label", "x.estimate", "x.std_error", "x.p")


def result_tables(spark: SparkSession, config: dict[str, Any], formats: list[str], wanted: list[str] | None = None) -> dict[str, str]:
    """The newest results as one table in each format, written beside them."""
    rows = coefficient_rows(newest(spark, config["results"])).cache()
    models = [s["model_name"] for s in model_specs(spark, config, wanted)]
    done = {r.model for r in rows.select("model").distinct().collect()}
    table = report.table(rows, [m for m in models if m in done]).drop("stage")
    out = {}
    for kind in formats:
        out[kind] = report.render(table, kind)
        files.write_text(spark, f"{config['results']}/_tables/table.{kind}", out[kind])
    rows.unpersist()
    return out


def summary(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Which models have results, how many, and the newest of each."""
    names = spark.createDataFrame([(s["model_name"],) for s in model_specs(spark, config)], "model_name string")
    have = results(spark, config["results"]).groupBy(F.col("analysis_metadata.model_name").alias("model_name")).agg(F.count(F.lit(1)).alias("n_results"), F.max("stamp").alias("newest"), F.max_by("sample_info.n", "stamp").alias("n_rows"))
    return names.join(have, "model_name", "left").fillna(0, ["n_results"]).orderBy("model_name")


def labels_of(config: dict[str, Any], formula_text: str, where: str | None, source: str, cluster: str | None) -> dict[str, str]:
    """What a result's own formula, condition, table and cluster mean in the configuration's labels; an unknown one is an error."""
    parsed = formula.parse(formula_text)
    effect = [label for label, terms in config["effects"].values() if sorted(terms) == sorted(parsed.effects)]
    place = [(name, years) for name, (table, years) in config["sources"].items() if table == source]
    cluster = cluster or (parsed.cluster[0] if parsed.cluster else None)
    clusters = [label for label, column in config["clusters"].values() if column == cluster] if cluster else [""]
    for what, found in (("effects", effect), ("source", place), ("cluster", clusters)):
        if not found:
            raise ValueError(f"no label for the {what} of {formula_text!r} on {source}")
    low, high = specs.temporal_extent(where or "")
    years = place[0][1] if low is None or high is None else f"{low}-{high}"
    return {"fixed_effects": effect[0], "resolution": place[0][0], "temporal_extent": years, "clustering": clusters[0]}


def _model_key(text: str) -> tuple:
    f = formula.parse(text)
    return f.y, tuple(sorted(f.x)), tuple(sorted(f.endog)), tuple(sorted(f.instruments))


def relabelled(spark: SparkSession, config: dict[str, Any]) -> list[tuple[str, str]]:
    """Results that lie elsewhere than the sheet and the labels of today say, and where they belong.

    A result's model is the one of the sheet with its variables and its own condition (without
    years), the one of its old name if there are several; one without a model is an error.
    """
    known: dict[tuple, list[dict[str, Any]]] = {}
    for spec in model_specs(spark, config):
        known.setdefault((_model_key(spec["formula"]), specs.without_years(spec["where"] or "")), []).append(spec)
    out = []
    for r in results(spark, config["results"]).select("path", "stamp", "analysis_metadata").collect():
        meta = r.analysis_metadata.asDict()
        fitting = known.get((_model_key(meta["formula"]), specs.without_years(meta.get("where") or "")), [])
        named = [s for s in fitting if s["model_name"] == meta["model_name"]]
        if len(fitting) != 1 and len(named) != 1:
            raise ValueError(f"{r.path}: {len(fitting)} models of the sheet fit")
        spec = named[0] if len(named) == 1 else fitting[0]
        own = labels_of(config, meta["formula"], meta.get("where"), meta["source"], meta.get("cluster"))
        variant = [spec["model_name"], own["fixed_effects"], own["resolution"], own["temporal_extent"], meta.get("spatial_extent") or specs.FULL_SAMPLE, own["clustering"]]
        to = f"{config['results']}/{_variant({'variant_path': variant})}/{r.stamp}"
        if files.bare(to) != files.bare(r.path):
            out.append((r.path, to))
    return sorted(out)


def relabel(spark: SparkSession, config: dict[str, Any], dry_run: bool = False) -> list[tuple[str, str]]:
    """Moves results to where `relabelled` says; nothing is moved onto a result that is there."""
    moves = relabelled(spark, config)
    for old, new in () if dry_run else moves:
        files.move(spark, old, new)
    return moves


def cleanup(spark: SparkSession, config: dict[str, Any], dry_run: bool = False) -> list[str]:
    """Removes all results of a variant but the newest; returns them."""
    every = results(spark, config["results"]).select("path", "variant", "stamp")
    old = [r.path for r in every.join(specs.newest_results(every, ["variant"], "stamp").select(F.col("path").alias("newest")), F.col("path") == F.col("newest"), "left_anti").orderBy("path").collect()]
    if not dry_run:
        for path in old:
            files.remove(spark, path)
    return old
