"""Writers: tiles, tables, results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.regression import Fit


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_tiles(df: DataFrame, path: str, by: tuple[str, ...] = ("ix", "iy"), files_per_tile: int = 1) -> None:
    """Parquet by tile; only tiles in `df` are replaced. Rows are dealt by tile and a salt, so no task writes every tile."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_tile))
    df.repartition(*by, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def tiles_to_do(spark: SparkSession, tiles: DataFrame, path: str, by: tuple[str, ...] = ("ix", "iy"), update: bool = False) -> DataFrame:
    """Tiles without rows at `path`; with `update` those that have some."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return tiles.limit(0) if update else tiles
    done = spark.read.parquet(path).select(*by).distinct()
    return tiles.join(done, list(by), "left_semi" if update else "left_anti")


def tile_counts(spark: SparkSession, path: str, by: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    return spark.read.parquet(path).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def valid_tiles(spark: SparkSession, path: str, by: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """`by`, `n_rows`, `n_files`, `n_unread` and `valid` of each tile: valid if it has rows and every file of it can be read.

    Files are listed without being opened; a file that gives no row, since it is broken or has none, counts as unread.
    Files of no bytes are not listed: a tile of nothing else has no row here.
    """
    schema = spark.read.option("ignoreCorruptFiles", "true").parquet(path).schema
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    read = rows.groupBy(*by, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    parts = [F.regexp_extract("path", rf"/{k}=([^/]+)/", 1).cast(rows.schema[k].dataType).alias(k) for k in by]
    there = files.select(*parts, F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    seen = read.select(*by, F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "n")
    tiles = there.join(seen, [*by, "name"], "left").groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n").isNull()).alias("n_unread"))
    return tiles.withColumn("valid", (F.col("n_rows") > 0) & (F.col("n_unread") == 0))


def swap(df: DataFrame, path: str) -> None:
    """Rewrites a table that may be read by `df`: staged beside it, then renamed. Between two renames there is no table; `tables.replace` has no such moment."""
    spark = df.sparkSession
    staged, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, path_of(old))
    fs.rename(path_of(staged), target)
    fs.delete(path_of(old), True)


def write_single(df: DataFrame, path: str) -> None:
    """A small table as one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, key: str) -> None:
    """Rows of `incoming` replace those of the same key at `path`."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        incoming.write.parquet(path)
        return
    old = spark.read.parquet(path)
    swap(old.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True), path)


def result_dict(fit: Fit, **metadata: object) -> dict:
    """A fit as nested JSON: metadata, coefficients, sample, statistics, first stages."""
    rows = fit.rows()
    return {
        "analysis_metadata": metadata,
        "coefficients": {"names": [r[0] for r in rows], "estimates": [r[1] for r in rows], "std_errors": [r[2] for r in rows], "p_values": [r[4] for r in rows], "vcov": fit.vcov.tolist()},
        "sample_info": {"n": fit.n, "df": fit.df},
        "model_statistics": fit.stats,
        "first_stage": {k: {"f_statistic": v.stats["f"], **result_dict(v)["coefficients"]} for k, v in fit.first_stage.items()},
    }


def write_result(spark: SparkSession, fit: Fit, path: str, **metadata: object) -> None:
    """results.json, coefficients (csv) and a csv for each first stage in a folder."""
    fs, _ = _fs(spark, path)
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/results.json"), True)
    out.write(bytearray(json.dumps(result_dict(fit, **metadata), indent=1).encode()))
    out.close()
    for name, one in {"coefficients": fit, **{f"first_stage_{k}": v for k, v in fit.first_stage.items()}}.items():
        spark.createDataFrame(one.rows(), "name string, estimate double, std_error double, t double, p double").coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_provenance(spark: SparkSession, path: str, **facts: object) -> None:
    """A YAML note of plain facts beside an output."""
    fs, target = _fs(spark, f"{path}/_provenance.yaml")
    out = fs.create(target, True)
    out.write(bytearray("".join(f"{k}: {json.dumps(v, default=str)}\n" for k, v in facts.items()).encode()))
    out.close()
