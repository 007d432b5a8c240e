"""Readers: tables, text files with odd headers, small office files, configurations."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.values import unpack
from panelspark.operators.panel import resolve_column


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A parquet scan; the filter and the columns reach the files."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where is not None else df
    return df.select(*columns) if columns else df


def resolve(df: DataFrame, candidates: list[str], keys: tuple[str, ...] = ()) -> str:
    """The column that the candidates name (see `resolve_column`); none is an error."""
    found = resolve_column(df, candidates, keys)
    if found is None:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return found


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding)
    return df.select(*columns) if columns else df


def headed_table(spark: SparkSession, path: str, header: list[str], sep: str = ",") -> DataFrame:
    """A text table whose header line stands somewhere below the top: rows after the first line that holds all of `header`.

    Rows with nothing in them are left out; all columns are strings.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    cells = F.transform(F.split("value", sep), lambda x: F.trim(x))
    found = lines.filter(F.array_except(F.array(*[F.lit(h) for h in header]), cells).isNull() | (F.size(F.array_except(F.array(*[F.lit(h) for h in header]), cells)) == 0))
    first = found.orderBy("at").first()
    if first is None:
        raise ValueError(f"no header with {header}")
    names = [x.strip() or f"column_{i}" for i, x in enumerate(first["value"].split(sep))]
    rows = lines.filter((F.col("at") > first["at"]) & (F.trim(F.replace("value", F.lit(sep), F.lit(""))) != "")).select(cells.alias("c"))
    return rows.select(*[F.nullif(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def excel(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0, skip_tail: int = 0) -> DataFrame:
    """A sheet of an office file, read on the driver: for configuration and codebooks, not for data."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, header=header, skipfooter=skip_tail))


def stata(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Stata file, read on the driver in chunks that stay small."""
    import pandas as pd

    parts = [spark.createDataFrame(p) for p in pd.read_stata(path, columns=columns, chunksize=100_000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_texts(df: DataFrame, column: str, paths: list[str], name: str = "text") -> DataFrame:
    """The first of several JSON paths that holds a value."""
    return df.withColumn(name, F.coalesce(*[F.get_json_object(column, p) for p in paths]))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def dataset(df: DataFrame, columns: list[str], keys: list[str], time: str | None = None, years: tuple[int, int] | None = None, prefix: str = "", packing: dict[str, tuple[float, float, int | None]] | None = None) -> DataFrame:
    """A gridded source ready to assemble: year from time, years filtered, columns chosen, unpacked, prefixed, as doubles."""
    if time:
        df = df.withColumn("year", F.year(time).cast("smallint"))
    if years:
        df = df.filter(F.col("year").between(*years))
    found = [c for c in columns if c in df.columns]
    if not found:
        raise ValueError(f"none of {columns} in the source")
    values = [(unpack(F.col(c), *packing[c]) if packing and c in packing else F.col(c).cast("double")).alias(prefix + c) for c in found]
    return df.select(*[k for k in [*keys, "year"] if k in df.columns], *values)


def variable_info(metadata: DataFrame, dataset: str | None = None, variable: str | None = None) -> dict[str, dict[str, Any]]:
    """What a metadata table (dataset, variable, ...) says, by `dataset.variable`, for a dataset, a variable or both; nothing found is an error."""
    rows = metadata
    for column, wanted in (("dataset", dataset), ("variable", variable)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    found = {f"{r.dataset}.{r.variable}": {k: v for k, v in r.asDict().items() if k not in ("dataset", "variable")} for r in rows.collect()}
    if not found:
        raise KeyError(f"no metadata of {dataset or 'any dataset'}, {variable or 'any variable'}")
    return found


def packing_of(metadata: DataFrame, dataset: str) -> dict[str, tuple[float, float, int | None]]:
    """Scale, offset and fill of each variable of a dataset, as `dataset(packing=...)` takes them."""
    return {k.split(".", 1)[1]: (float(v.get("scale") or 1.0), float(v.get("offset") or 0.0), v.get("fill")) for k, v in variable_info(metadata, dataset).items()}


def _expand(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_expand(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def deep_merge(base: Any, over: Any) -> Any:
    """Dicts merge key by key, anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {**base, **{k: deep_merge(base[k], v) if k in base else v for k, v in over.items()}}
    return over


def config(path: str) -> dict[str, Any]:
    """A JSON (or YAML, where PyYAML is there) file with environment variables expanded; `NAME.local.EXT` beside it wins."""

    def load(p: str) -> dict[str, Any]:
        with open(p, encoding="utf-8") as f:
            if p.endswith(".json"):
                return json.load(f)
            import yaml

            return yaml.safe_load(f) or {}

    root, ext = os.path.splitext(path)
    out = load(path)
    if os.path.exists(f"{root}.local{ext}"):
        out = deep_merge(out, load(f"{root}.local{ext}"))
    return _expand(out)
