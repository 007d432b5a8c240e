"""Panel assembly: joins that keep missing keys, updates, intervals, set logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranks import placed


def full_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which null keys match null keys; an equi sort-merge join all the same."""
    # Names of its own for the right side: both may come from one table.
    values = [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(values)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    merged = [F.coalesce(F.col(k), F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)]
    return left.join(other, same, "full").select(*merged, *[F.col(c) for c in left.columns if c not in keys], *[F.col(f"__v{i}").alias(c) for i, c in enumerate(values)])


def combine(tables: list[DataFrame], index: list[str], policy: str = "progressive") -> DataFrame:
    """Full outer join of all tables, in order.

    `progressive` joins on the index columns that both sides have so far, so a
    table without a year spreads over the years of a later one. `strict` asks every
    table for all index columns and fills those it lacks with nulls.
    """
    if not tables:
        raise ValueError("nothing to combine")
    if policy == "strict":
        tables = [t.select(*[F.col(k) if k in t.columns else F.lit(None).alias(k) for k in index], *[c for c in t.columns if c not in index]) for t in tables]

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = [k for k in index if k in left.columns and k in right.columns]
        if not keys:
            raise ValueError("two tables without a common index column")
        return full_join(left, right, keys)

    return reduce(step, tables)


def seeded(seed: DataFrame, tables: list[DataFrame], index: list[str], missing: float | None = 0.0) -> DataFrame:
    """A row for each (id, year) of `seed` and of the tables, all of which have the whole `index`: full outer joins from the seed on.

    Missing values become `missing` (None: stay), and rows come by index columns first, then table by table.
    """
    lacking = [t.columns for t in tables if not set(index) <= set(t.columns)]
    if lacking:
        raise ValueError(f"a table without {index}: {lacking[0]}")
    out = combine([seed.select(*index).distinct(), *tables], index)
    values = [c for c in out.columns if c not in index]
    out = out.select(*index, *values)
    return out if missing is None or not values else out.fillna(missing, values)


def update_merge(base: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """`base` with the columns of `new` in place of its own of that name; never more rows.

    Of several new rows of a key the least counts, column by column in order (by its JSON, where a
    column has no order), or that of the least `order`.
    """
    values = [c for c in new.columns if c not in keys]
    least = F.min_by(F.struct(*values), order if order is not None else F.to_json(F.struct(*values))) if order is not None or any("map<" in new.schema[c].dataType.simpleString() for c in values) else F.min(F.struct(*values))
    once = new.groupBy(*keys).agg(least.alias("__v")).select(*keys, *[F.col("__v")[c].alias(c) for c in values]) if values else new.distinct()
    kept = base.drop(*[c for c in new.columns if c not in keys])
    right = once.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in new.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return kept.join(right, same, "left").drop(*[f"__{k}" for k in keys])


def order_columns(df: DataFrame, index: list[str], derived: list[str], datasets: list[str]) -> DataFrame:
    """Index, derived keys, then the columns of each dataset (by prefix) in order, then the rest."""
    first = [c for c in [*index, *derived] if c in df.columns]
    by_set = [c for p in datasets for c in df.columns if c.startswith(p) and c not in first]
    done = list(dict.fromkeys([*first, *by_set]))
    return df.select(*done, *[c for c in df.columns if c not in done])


def fill(df: DataFrame, value: float | dict[str, float], prefix: str = "") -> DataFrame:
    """Missing values; a dict names columns with or without their prefix."""
    if not isinstance(value, dict):
        return df.fillna(value)
    return df.fillna({c: v for k, v in value.items() for c in (k, prefix + k) if c in df.columns})


def select_available(df: DataFrame, wanted: list[str], prefix: str = "", keys: tuple[str, ...] = ()) -> tuple[DataFrame | None, list[str]]:
    """The wanted columns that exist (prefixed), and those that do not; None if none exists."""
    found = [c for c in wanted if c in df.columns and c not in keys]
    missing = [c for c in wanted if c not in df.columns]
    if not found:
        return None, missing
    return df.select(*[k for k in keys if k in df.columns], *[F.col(c).alias(prefix + c) for c in found]), missing


def resolve_column(df: DataFrame, candidates: list[str], keys: tuple[str, ...] = ()) -> str | None:
    """The column that the first candidate names, exactly or else in other case; else the only one beside `keys`; else none."""
    found = [c for c in df.columns if c not in keys]
    lower = {c.lower(): c for c in found}
    for c in candidates:
        if c in found:
            return c
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return found[0] if len(found) == 1 else None


def explode_years(df: DataFrame, start: Column, end: Column, low: int | None = None, high: int | None = None, name: str = "year") -> DataFrame:
    """A row for each year of [start, end] within [low, high]; an open end is `high`; an empty interval has no row."""
    lo = F.greatest(start, F.lit(low)) if low is not None else start
    hi = F.least(F.coalesce(end, F.lit(high)), F.lit(high)) if high is not None else end
    return df.withColumn("__lo", lo.cast("int")).withColumn("__hi", hi.cast("int")).filter("__lo <= __hi").withColumn(name, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def first_match(points: DataFrame, spells: DataFrame, key: str, at: str, start: str, end: str, order: str, values: list[str]) -> DataFrame:
    """For each (key, at) the values of the first spell, by `order`, that covers it; null without one.

    Spells are exploded to the years they cover and thinned to one a (key, year)
    before the join, which then is an equi-join: no range join, no growth.
    """
    years = explode_years(spells.select(key, start, end, order, *values), F.col(start), F.col(end), name=at)
    best = years.groupBy(key, at).agg(F.min_by(F.struct(*values), order).alias("__v"))
    return points.join(best, [key, at], "left").select(*points.columns, *[F.col("__v")[v].alias(v) for v in values])


def active_counts(spells: DataFrame, by: list[str], start: str, end: str, low: int, high: int) -> DataFrame:
    """How many spells are active in each group and year."""
    return explode_years(spells, F.col(start), F.col(end), low, high).groupBy(*by, "year").agg(F.count(F.lit(1)).alias("n_active"))


def last_known(df: DataFrame, key: list[str], year: str, values: list[str], cuts: list[int]) -> DataFrame:
    """For each cut-off year and column the last value that is not null up to then: one pass, no window."""
    aggs = [F.max_by(v, F.when(F.col(v).isNotNull() & (F.col(year) <= cut), F.col(year))).alias(f"{v}_{cut}") for cut in cuts for v in values]
    return df.groupBy(*key).agg(*aggs)


def encode_labels(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Adds the rank (1..N) of a label among the sorted distinct ones; null: 0. Only the distinct labels are ranked."""
    labels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__l")).distinct()
    codes = placed(labels, ["__l"], "__p").select("__l", (F.col("__p") + 1).cast("int").alias(name))
    return df.join(codes, F.col(column) == F.col("__l"), "left").drop("__l").withColumn(name, F.coalesce(name, F.lit(0)))


def new_rows(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """`existing` and the rows of `batch` whose key it lacks (columns by name, missing ones null)."""
    return existing.unionByName(batch.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of `incoming` replace those of the same key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def missing_keys(every: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return every.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_where_any(df: DataFrame, keys: list[str], mask: DataFrame, flag: str, values: list[str]) -> DataFrame:
    """Values only where the mask says so; rows whose values are all missing go."""
    joined = df.join(mask.select(*keys, flag), keys, "left")
    masked = joined.select(*[c for c in df.columns if c not in values], *[F.when(F.col(flag), F.col(v)).alias(v) for v in values])
    return masked.dropna(how="all", subset=values)


def factorize(df: DataFrame, column: str, order: str, name: str = "code") -> DataFrame:
    """Adds 0, 1, ... for a label by where it first appears; null: -1. Only the distinct labels are ranked."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__l")).agg(F.min(order).alias("__o"))
    codes = placed(first, ["__o", "__l"], "__p").select("__l", F.col("__p").cast("int").alias(name))
    return df.join(codes, F.col(column) == F.col("__l"), "left").drop("__l").withColumn(name, F.coalesce(name, F.lit(-1)))


def two_hop(df: DataFrame, column: str, first: DataFrame, second: DataFrame, name: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with `name`, labels without one) of a label mapped twice: `first` has label and code, `second` code and id."""
    one = first.select(F.col("label").alias(column), F.col("code").alias("__c")).dropDuplicates([column])
    two = second.select(F.col("code").alias("__c"), F.col("id").alias(name)).dropDuplicates(["__c"])
    mapped = df.join(one, column, "left").join(two, "__c", "left").drop("__c")
    return mapped, mapped.filter(F.col(name).isNull() & F.col(column).isNotNull()).select(column).distinct()


def align(left: DataFrame, right: DataFrame, lat: str, lon: str, step: float, how: str = "inner") -> DataFrame:
    """Joins two gridded tables on the integer index of their coordinates, never on floating point numbers."""
    index = lambda c: F.bround(F.col(c) / step).cast("long")
    a = left.withColumns({"row": index(lat), "col": index(lon)}).drop(lat, lon)
    b = right.withColumns({"row": index(lat), "col": index(lon)}).drop(lat, lon)
    return a.join(b, ["row", "col"], how).withColumns({lat: F.col("row") * step, lon: F.col("col") * step})


def dense(df: DataFrame, axes: dict[str, tuple[int, int]], values: list[str], missing: float | None = None) -> DataFrame:
    """Every cell of the axes' ranges [low, high], with nulls (or `missing`) where the table has none: one range, no driver loop."""
    size = 1
    for low, high in axes.values():
        size *= high - low + 1
    cells, step = df.sparkSession.range(size), 1
    for name, (low, high) in reversed(axes.items()):
        cells = cells.withColumn(name, (F.col("id") / step).cast("long") % (high - low + 1) + low)
        step *= high - low + 1
    out = cells.drop("id").join(df.select(*axes, *values), list(axes), "left")
    return out if missing is None else out.fillna(missing, values)


def wide_flags(df: DataFrame, row: str, column: str, labels: list[str], base: DataFrame | None = None) -> DataFrame:
    """A boolean column for each label a row has; rows of `base` without any are all false."""
    flags = df.groupBy(row).agg(*[F.max(F.coalesce(F.col(column) == x, F.lit(False))).alias(x) for x in labels])
    if base is None:
        return flags
    return base.select(row).distinct().join(flags, row, "left").select(row, *[F.coalesce(x, F.lit(False)).alias(x) for x in labels])


def grouped_files(files: DataFrame, by: list[str], path: str) -> DataFrame:
    """The files of each group, in order (a group is a year's or a tile's files)."""
    return files.groupBy(*by).agg(F.sort_array(F.collect_list(path)).alias("files"), F.count(F.lit(1)).alias("n_files"))
