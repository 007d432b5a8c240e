"""Extension points: callables by import path, sources and reducers by name."""

from __future__ import annotations

import importlib
from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(path: str) -> Callable:
    """`package.module:function`."""
    module, _, name = path.partition(":")
    found = getattr(importlib.import_module(module), name or "", None)
    if not callable(found):
        raise ValueError(f"no callable at {path}")
    return found


class Preprocessor(ABC):
    """A source's way from raw tables to a panel table, target by target."""

    @abstractmethod
    def targets(self) -> list[str]: ...

    @abstractmethod
    def process(self, target: str, tables: dict[str, DataFrame]) -> DataFrame: ...


PREPROCESSORS: dict[str, type[Preprocessor]] = {}


def preprocessor(name: str):
    """Registers a Preprocessor class under a name."""

    def add(cls: type[Preprocessor]) -> type[Preprocessor]:
        PREPROCESSORS[name] = cls
        return cls

    return add


class DataSource(ABC):
    """A source of tables: what it has, and each of them."""

    def __init__(self, **options: object):
        self.options = options

    @abstractmethod
    def names(self) -> list[str]: ...

    @abstractmethod
    def table(self, spark: SparkSession, name: str) -> DataFrame: ...


SOURCES: dict[str, type[DataSource]] = {}


def data_source(name: str):
    """Registers a DataSource class under a name."""

    def add(cls: type[DataSource]) -> type[DataSource]:
        SOURCES[name] = cls
        return cls

    return add


def create_source(config: dict[str, object]) -> DataSource:
    """The source that a configuration's `type` names (or an import path says), made with its other entries."""
    kind = str(config["type"])
    cls = SOURCES.get(kind) or (resolve(kind) if ":" in kind else None)
    if cls is None:
        raise KeyError(f"no source {kind}; there are {sorted(SOURCES)}")
    return cls(**{k: v for k, v in config.items() if k != "type"})


@data_source("parquet")
class ParquetFolder(DataSource):
    """A folder of parquet tables: `path` and the `tables` in it."""

    def names(self) -> list[str]:
        return list(self.options["tables"])

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.options['path']}/{name}.parquet")


def with_years(files: DataFrame, year_of: Callable[[Column], Column], transform: Callable[[DataFrame], DataFrame] | None = None, variables: Callable[[list[str]], list[str]] | None = None, years: list[int] | None = None, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Rows of many files with the `year` that `year_of` finds in a file's path, for the `years` asked for; `transform` is applied to all of them, and `variables` chooses among their columns."""
    out = files.withColumn("year", year_of(F.col("_metadata.file_path")))
    out = out.filter(F.col("year").isin(years)) if years is not None else out.filter(F.col("year").isNotNull())
    out = transform(out) if transform else out
    own = [c for c in out.columns if c not in (*keys, "year")]
    return out.select(*[k for k in keys if k in out.columns], "year", *(variables(own) if variables else own))


def reduce_zones(df: DataFrame, by: list[str], value: str, reducer: str | Callable) -> DataFrame:
    """A zonal reduction by name, or by a Python function of a zone's values (an Arrow-batched grouped aggregate)."""
    from panelspark.operators.stats import aggregate_of

    if isinstance(reducer, str) and ":" not in reducer:
        return df.groupBy(*by).agg(aggregate_of(reducer, F.col(value), ddof=0).alias(value))
    f = resolve(reducer) if isinstance(reducer, str) else reducer
    def udf(v: pd.Series) -> float:
        return float(f(v.dropna().to_numpy()))

    return df.groupBy(*by).agg(F.pandas_udf(udf, "double")(F.col(value).cast("double")).alias(value))
