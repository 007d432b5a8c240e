"""A file catalogue as a table: build, dedup, status changes, queues and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.text import file_date, status_category
from panelspark.operators.batching import batches

__all__ = [
    "SCHEMA", "add", "batches", "build", "by_year", "full_directories", "migrate", "modern_status", "next_jobs", "pending", "pick", "preferred", "presence_advice", "stamp_census", "sync_advice", "totals", "update_status",
]

SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("file_hash", "relative_path", "source_url", "destination_blob")],
        T.StructField("file_size", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("date_added", T.TimestampType()),
        T.StructField("download_status", T.StringType()),
        T.StructField("status_category", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("day_of_year", T.IntegerType()),
    ]
)


def build(files: DataFrame) -> DataFrame:
    """Catalogue rows of files (source_url, relative_path, ...): hash, dates from the name, category."""
    year, day = file_date(F.col("relative_path"))
    made = files.withColumns({"file_hash": F.md5("source_url"), "year": year, "day_of_year": day})
    return migrate(made).withColumn("status_category", status_category(F.col("download_status")))


def migrate(old: DataFrame) -> DataFrame:
    """Any catalogue in today's schema: known columns cast, missing ones null."""
    return old.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in old.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA.fields])


def add(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue with the files whose hash it lacks; equal hashes within `files` all come in."""
    return catalog.unionByName(files.join(catalog.select("file_hash"), "file_hash", "left_anti"), allowMissingColumns=True)


def update_status(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Statuses from `updates` (file_hash, download_status, ordinal): the last of a file wins; an unknown one leaves its category."""
    last = updates.groupBy("file_hash").agg(F.max_by("download_status", "ordinal").alias("__s"))
    known = status_category(F.col("__s"))
    hit = F.col("__s").isNotNull()
    put = {
        "download_status": F.when(hit, F.col("__s")).otherwise(F.col("download_status")),
        "status_category": F.when(hit & (known != "other"), known).otherwise(F.col("status_category")),
    }
    joined = catalog.join(last, "file_hash", "left")
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in catalog.columns])


def pending(catalog: DataFrame, limit: int, retry_failed: bool = False) -> DataFrame:
    """The smallest pending files first, unknown sizes last, ties by hash: a top-k, not a sort."""
    wanted = ["pending", "failed"] if retry_failed else ["pending"]
    return catalog.filter(F.col("status_category").isin(wanted)).orderBy(F.asc_nulls_last("file_size"), "file_hash").limit(limit)


def _counts() -> list[Column]:
    return [F.count_if(F.col("status_category") == s).alias(f"n_{s}") for s in ("pending", "downloading", "failed", "completed", "other")]


def totals(catalog: DataFrame) -> DataFrame:
    known = F.when(F.col("year") > 0, F.col("year"))
    return catalog.agg(F.count(F.lit(1)).alias("n_files"), *_counts(), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count_distinct(known).alias("n_years"), F.min(known).alias("min_year"), F.max(known).alias("max_year"))


def by_year(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("year").agg(F.count(F.lit(1)).alias("n_files"), *_counts(), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.avg("file_size").alias("mean_size"))


def preferred(files: DataFrame, by: list[str], extension: str, order: list[str]) -> DataFrame:
    """One file for each group: the extension first in `order`, then by path."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(extension)), F.lit(0)), F.lit(len(order) + 1))
    w = Window.partitionBy(*by).orderBy(rank, "relative_path")
    return files.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def pick(rows: DataFrame, column: str, wanted: object | None, order: str) -> DataFrame:
    """One row: the first with the wanted value, else the first, by `order`. A top-1, not a sort."""
    first = F.coalesce(F.col(column) == F.lit(wanted), F.lit(False)) if wanted is not None else F.lit(False)
    return rows.orderBy(F.desc(first), order).limit(1)


def full_directories(files: DataFrame, path: str, least: int, ending: str = "") -> DataFrame:
    """`directory` and `n_files` of directories with `least` files or more whose names have the ending."""
    own = files.filter(F.endswith(F.lower(path), F.lit(ending.lower()))) if ending else files
    counts = own.groupBy(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"))
    return counts.filter(F.col("n_files") >= least)


def presence_advice(pairs: DataFrame) -> DataFrame:
    """`advice` for (local_exists, remote_exists): only whether there is an index counts."""
    a, b = F.coalesce("local_exists", F.lit(False)), F.coalesce("remote_exists", F.lit(False))
    return pairs.withColumn("advice", F.when(a & b, "compare").when(a, "push").when(b, "pull").otherwise("none"))


def sync_advice(pairs: DataFrame) -> DataFrame:
    """`advice` for (local_files, remote_files, local_time, remote_time): more files win, then the later time."""
    lf, rf, lt, rt = (F.col(c) for c in ("local_files", "remote_files", "local_time", "remote_time"))
    advice = (
        F.when(lf.isNull() & rf.isNull(), "none").when(rf.isNull(), "push").when(lf.isNull(), "pull")
        .when(lf > rf, "push").when(rf > lf, "pull").when(lt > rt, "push").when(rt > lt, "pull").otherwise("in_sync")
    )
    return pairs.withColumn("advice", advice)


def next_jobs(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The first waiting jobs, unless one is active or has failed."""
    busy = jobs.filter(F.col("status").isin("active", "failed")).agg(F.count(F.lit(1)).alias("__busy"))
    waiting = jobs.filter(F.col("status") == "waiting").orderBy("ordinal").limit(limit)
    return waiting.join(F.broadcast(busy)).filter("__busy = 0").drop("__busy")


def stamp_census(catalog: DataFrame, column: str = "timestamp") -> DataFrame:
    """How many stamps are missing, statuses of the old kind, dates, or anything else."""
    c = F.lower(F.trim(column))
    old = c.isin("pending", "downloading", "completed") | c.startswith("failed")
    date = c.rlike(r"^\d{4}-\d{2}-\d{2}")
    return catalog.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.isNull() | (c == "")).alias("n_missing"), F.count_if(old).alias("n_status"), F.count_if(date).alias("n_date"),
        F.count_if(c.isNotNull() & (c != "") & ~old & ~date).alias("n_other"),
    )


def modern_status(stamp: Column) -> Column:
    """Today's status of an old stamp: a date means completed, nothing means pending."""
    low = F.lower(F.trim(stamp))
    return (
        F.when(low.isNull() | (low == "") | (low == "pending"), "pending").when(low.rlike(r"^\d{4}-\d{2}-\d{2}"), "completed").when(low.startswith("failed"), F.concat(F.lit("FAILED"), F.substring(F.trim(stamp), F.lit(7), F.length(stamp))))
        .when(low == "downloading", "DOWNLOADING").when(low == "completed", "completed").otherwise(stamp)
    )
