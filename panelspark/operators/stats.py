"""Aggregates and window statistics of panels and time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.quantiles import join_keys, quantiles, with_quantiles

#: Names people use for the same aggregate.
ALIASES = {"avg": "mean", "average": "mean", "med": "median"}


def aggregate_of(name: str, c: Column, order: Column | None = None, ddof: int = 1) -> Column:
    """A named aggregate over values that are not missing. first and last follow `order`."""
    name = ALIASES.get(name, name)
    simple = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    if name in simple:
        return simple[name](c)
    if name == "median":
        return F.percentile(c, 0.5)
    if name == "mode":
        return F.mode(c, True)
    if name in ("std", "var"):
        return {("std", 0): F.stddev_pop, ("std", 1): F.stddev_samp, ("var", 0): F.var_pop, ("var", 1): F.var_samp}[name, ddof](c)
    if name in ("first", "last"):
        if order is None:
            raise ValueError(f"{name} needs an order")
        return (F.min_by if name == "first" else F.max_by)(c, F.when(c.isNotNull(), order))
    raise ValueError(f"no aggregate {name}")


def zonal(df: DataFrame, by: list[str], value: str, names: list[str], order: str | None = None, ddof: int = 1) -> DataFrame:
    """Aggregates of a value by zone, missing values left out. Partial sums meet per zone, so raw rows do not move."""
    c = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    names = [ALIASES.get(n, n) for n in names]
    out = df.groupBy(*by).agg(*[aggregate_of(n, c, F.col(order) if order else None, ddof).alias(f"{value}_{n}") for n in names if n != "median"] or [F.lit(0).alias("__none")])
    if "median" in names:
        out = with_quantiles(out, df, by, c, {f"{value}_median": 0.5})
    return out.select(*by, *[f"{value}_{n}" for n in names])


def annual_stats(df: DataFrame, by: list[str], value: str, hot: float, cold: float) -> DataFrame:
    """Mean, median, deviation (population), extremes, and how many values there are, above `hot` and below `cold`."""
    v = F.col(value)
    out = df.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.count_if(v > hot).alias("n_hot"), F.count_if(v < cold).alias("n_cold"), F.count(v).alias("n_valid"),
    )
    return with_quantiles(out, df, by, v, {"median": 0.5}).select(*by, "mean", "median", "std", "max", "min", "n_hot", "n_cold", "n_valid")


def rolling_extrema(df: DataFrame, by: list[str], unit: str, order: str, value: str) -> DataFrame:
    """Greatest and least centred mean of three observations, full windows only, for each group of `by`."""
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(-1, 1)
    rolled = df.withColumn("__m", F.when(F.count(value).over(w) == 3, F.avg(value).over(w)))
    return rolled.groupBy(*by).agg(F.max("__m").alias("roll_max"), F.min("__m").alias("roll_min"))


def lags(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each value's predecessor in its group, and the difference."""
    w = Window.partitionBy(*by).orderBy(*order)
    prev = {v: F.lag(v).over(w) for v in values}
    return df.select("*", *[p.alias(f"{v}_lag") for v, p in prev.items()], *[(F.col(v) - p).alias(f"{v}_diff") for v, p in prev.items()])


def with_means(df: DataFrame, by: list[str], names: dict[str, str], broadcast: bool = False) -> DataFrame:
    """`df` and the group mean of each value (value -> new name).

    Means come from partial aggregates and are joined back, so that no group has
    to meet in one task; null keys are a group. `broadcast` is for callers that
    know the groups to be few; else Spark goes by the means' size as it runs.
    """
    keys = {k: f"__key_{i}" for i, k in enumerate(by)}
    means = df.groupBy(*[F.col(k).alias(n) for k, n in keys.items()]).agg(*[F.avg(v).alias(n) for v, n in names.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in keys.items()])
    return df.join(F.broadcast(means) if broadcast else means, same).drop(*keys.values())


def within(df: DataFrame, by: list[str], values: list[str], suffix: str = "_within") -> DataFrame:
    """Values less their group means."""
    names = {v: f"__mean_{i}" for i, v in enumerate(values)}
    return with_means(df, by, names).select(*df.columns, *[(F.col(v) - F.col(m)).alias(v + suffix) for v, m in names.items()])


def twoway_demean(df: DataFrame, unit: str, time: str, values: list[str], suffix: str = "_twoway_demeaned") -> DataFrame:
    """Unit means out, then the time means of what is left."""
    first = within(df, [unit], values, "__u")
    second = within(first, [time], [f"{v}__u" for v in values], "__t")
    return second.select(*df.columns, *[F.col(f"{v}__u__t").alias(v + suffix) for v in values])


def group_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Group means beside the rows (Mundlak terms)."""
    return with_means(df, by, {v: f"{v}_mean_{'_'.join(by)}" for v in values})


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float, int], y_range: tuple[float, float, int]) -> DataFrame:
    """Counts and shares on the whole grid of bins; values outside go to the outer bins."""

    def bin_of(c: str, r: tuple[float, float, int]) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(r[2] - 1), F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / r[2])))).cast("int")

    counts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(x, x_range).alias("bx"), bin_of(y, y_range).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    cells = x_range[2] * y_range[2]
    grid = df.sparkSession.range(cells).select((F.col("id") / y_range[2]).cast("int").alias("bx"), (F.col("id") % y_range[2]).cast("int").alias("by"))
    total = counts.agg(F.sum("n").alias("total"))
    out = grid.join(counts, ["bx", "by"], "left").fillna(0, ["n"])
    return out.join(F.broadcast(total)).select("bx", "by", "n", F.try_divide("n", "total").alias("share"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by category, zero where there are none, and row totals."""
    aggs = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(row).agg(*aggs, F.count(F.lit(1)).alias("n_all"))


def modal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of a group, the least of several: counts first, so a group never meets whole."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def islands(df: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Runs of equal labels in a row: `run` (from 1), the label, first and last place, length."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w))
    return runs.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def changepoint(df: DataFrame, by: list[str], order: str, value: str, min_side: int = 2) -> DataFrame:
    """For each group the split into two means with the least squared error: one sorted pass of running sums."""
    w = Window.partitionBy(*by).orderBy(order)
    every = Window.partitionBy(*by)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = df.select(
        *by, order, F.count(value).over(run).alias("k"), F.sum(value).over(run).alias("s"), F.sum(F.col(value) * F.col(value)).over(run).alias("q"),
        F.count(value).over(every).alias("n"), F.sum(value).over(every).alias("t"), F.sum(F.col(value) * F.col(value)).over(every).alias("tq"),
    )
    sse = F.col("q") - F.col("s") * F.col("s") / F.col("k") + (F.col("tq") - F.col("q")) - (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / (F.col("n") - F.col("k"))
    s = s.filter((F.col("k") >= min_side) & (F.col("n") - F.col("k") >= min_side)).withColumn("sse", F.round(sse, 4))
    s = s.withColumn("shift", (F.col("t") - F.col("s")) / (F.col("n") - F.col("k")) - F.col("s") / F.col("k"))
    best = s.groupBy(*by).agg(F.min_by(F.struct(order, "sse", "shift"), F.struct("sse", order)).alias("b"))
    return best.select(*by, F.col("b")[order].alias("split_after"), F.col("b.sse").alias("sse"), F.col("b.shift").alias("shift"))


def outlier_flags(df: DataFrame, by: list[str], value: str, q: float = 0.01, iqr: float = 1.5) -> DataFrame:
    """Whether a value lies beyond its group's outer quantiles, or beyond median -/+ iqr quartile distances."""
    cut = quantiles(df, by, [value], [q, 0.25, 0.5, 0.75, 1 - q]).withColumnRenamed(value, "__p")
    joined = join_keys(df, cut, by)
    p, v = F.col("__p"), F.col(value)
    far = iqr * (p[3] - p[1])
    return joined.select(*df.columns, ((v < p[0]) | (v > p[4])).alias("beyond_quantile"), ((v < p[2] - far) | (v > p[2] + far)).alias("beyond_iqr"))


def summary(df: DataFrame, by: list[str], value: str, success: Column) -> DataFrame:
    v = F.col(value)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(success).alias("n_success"), F.count_if(~success).alias("n_failed"),
    )
    return with_quantiles(out, df, by, v, {"median": 0.5, "p25": 0.25, "p75": 0.75}).select(*by, "n", "total", "mean", "median", "p25", "p75", "min", "max", "n_success", "n_failed")


def cluster_sizes(df: DataFrame, cluster: str, few: int = 50, uneven: float = 10.0) -> DataFrame:
    """How many clusters there are and how even they are, with warnings."""
    n = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.count(F.lit(1)).alias("n_clusters"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
    out = with_quantiles(out, n, [], "n", {"median_size": 0.5})
    return out.select("*", (F.col("n_clusters") < few).alias("few_clusters"), (F.col("max_size") > uneven * F.col("mean_size")).alias("uneven"))


def missing_shares(df: DataFrame, values: list[str]) -> DataFrame:
    """Shares of null and of zero in each column."""
    return df.agg(*[F.avg(F.col(v).isNull().cast("double")).alias(f"{v}_null_share") for v in values], *[F.avg((F.col(v) == 0).cast("double")).alias(f"{v}_zero_share") for v in values])


def pair_events(df: DataFrame, key: str, order: str, kind: str, start: str, end: str) -> DataFrame:
    """Each end event with the last start before it that no other end has taken (by key, in order)."""
    w = Window.partitionBy(key).orderBy(order)
    part = df.filter(F.col(kind).isin(start, end)).withColumn("__prev", F.lag(kind).over(w)).withColumn("__at", F.lag(order).over(w))
    return part.filter((F.col(kind) == end) & (F.col("__prev") == start)).select(key, F.col("__at").alias("started"), F.col(order).alias("completed"))
