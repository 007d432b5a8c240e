"""Named queries over the driver's tables, each with the DuckDB SQL that gives the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import grid, text, values
from panelspark.operators import absorb, catalog, density, panel, polygons, regression, spatial, stats, warp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer-year panel: exact sums of money, number of orders."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return o.groupBy("unit", "year").agg(F.sum("p").cast("double").alias("y"), F.count(F.lit(1)).alias("x"))


_PANEL = "SELECT o_custkey AS unit, year(o_orderdate)::BIGINT AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y, count(*) AS x FROM orders GROUP BY ALL"


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


# --- panel and keys -----------------------------------------------------------


@query(
    f"""WITH p AS ({_PANEL}), u AS (SELECT unit, year, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM p),
    t AS (SELECT y - avg(y) OVER (PARTITION BY year) AS y, x - avg(x) OVER (PARTITION BY year) AS x FROM u)
    SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 4) AS slope FROM t"""
)
def q_twfe_slope(spark, d):
    p = stats.twoway_demean(_panel(spark, d).withColumn("x", F.col("x").cast("double")), "unit", "year", ["y", "x"], "_d")
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x_d") * F.col("y_d")) / F.sum(F.col("x_d") * F.col("x_d")), 4).alias("slope"))


@query(
    """SELECT l_partkey AS pixel, year(l_shipdate)::SMALLINT AS year, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, round(avg(l_extendedprice), 4) AS mean_price
    FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY ALL"""
)
def q_panel_agg(spark, d):
    li = _t(spark, d, "lineitem").filter((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "2001-01-01"))
    return li.groupBy(F.col("l_partkey").alias("pixel"), F.year("l_shipdate").cast("smallint").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price")
    )


_CELLS = "(SELECT l_orderkey AS k, l_linenumber AS ln, (l_suppkey % 300)::BIGINT AS ix, (l_partkey % 700)::BIGINT AS iy, (l_orderkey * 7 + l_linenumber) % 4194304 AS local FROM lineitem)"


def _cells(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 300).alias("ix"), (F.col("l_partkey") % 700).alias("iy"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 4194304).alias("local"))


@query(f"SELECT k, ln, (ix << 48) | (iy << 32) | local AS pixel_id FROM {_CELLS}")
def q_pixel_id_encode(spark, d):
    return _cells(spark, d).select("k", "ln", grid.encode_cell(F.col("ix"), F.col("iy"), F.col("local")).alias("pixel_id"))


@query(f"SELECT k, ln, ix::INTEGER AS ix, iy::INTEGER AS iy, local FROM {_CELLS}")
def q_pixel_id_decode(spark, d):
    ix, iy, local = grid.decode_cell(F.col("pixel_id"))
    return q_pixel_id_encode(spark, d).select("k", "ln", ix.alias("ix"), iy.alias("iy"), local.alias("local"))


@query(f"SELECT k, ln, (ix << 48) | (iy << 32) | ((local // 2048) // 5 * 410 + (local % 2048) // 5) AS coarse, (ix << 48) | (iy << 32) | ((local // 2048) // 50 * 41 + (local % 2048) // 50) AS coarsest FROM {_CELLS}")
def q_derived_ids(spark, d):
    key = F.col("pixel_id")
    return q_pixel_id_encode(spark, d).select("k", "ln", grid.derived_cell(key, 2048, 5).alias("coarse"), grid.derived_cell(key, 2048, 50).alias("coarsest"))


@query(
    """SELECT c_custkey AS k, greatest(0, least(199, floor((c_acctbal / 60 - (90 - -1.0 / 2)) / -1.0)))::INTEGER AS row_down, greatest(0, least(359, floor((c_acctbal / 30 - (-180 - 0.25)) / 0.5)))::INTEGER AS col FROM customer"""
)
def q_coordinate_index(spark, d):
    bal = F.col("c_acctbal")
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), grid.coordinate_index(bal / 60, 90, -1.0, 200).alias("row_down"), grid.coordinate_index(bal / 30, -180, 0.5, 360).alias("col"))


@query(
    """WITH b AS (SELECT l_suppkey % 10 AS tile, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
    SELECT l_suppkey % 10 AS tile, l_orderkey AS k, l_linenumber AS ln, round(CASE WHEN l_quantity > 5 THEN least(greatest(l_extendedprice, lo), hi) END, 4) AS v FROM lineitem JOIN b ON b.tile = l_suppkey % 10"""
)
def q_winsorize_tile(spark, d):
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("tile"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")).alias("v"))
    return spatial.winsorize(li, ["tile"], ["v"], 0.05).select("tile", "k", "ln", _r("v"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 65535 WHEN o_totalprice > 200000 THEN 65535 ELSE round_even(o_totalprice / 4, 0)::INTEGER END AS packed FROM orders")
def q_pack(spark, d):
    v = F.when((F.col("o_orderkey") % 7 != 0) & (F.col("o_totalprice") <= 200000), F.col("o_totalprice"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), values.pack(v, 4.0).alias("packed"))


@query("SELECT p_partkey AS k, CASE WHEN p_size <> 11 THEN round(p_size * 0.25::DOUBLE - 3, 4) END AS v FROM part")
def q_unpack(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(values.unpack(F.col("p_size"), 0.25, -3.0, 11), 4).alias("v"))


_THREE = """a AS (SELECT o_custkey AS unit, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY ALL),
    b AS (SELECT nullif(l_suppkey % 500, 7) AS unit, year(l_shipdate)::INTEGER AS year, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL),
    c AS (SELECT nullif(c_custkey, 9) AS unit, c_mktsegment AS seg FROM customer)"""


@query(
    f"""WITH {_THREE}, ab AS (SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.year, b.year) AS year, n, q FROM a FULL JOIN b ON a.unit IS NOT DISTINCT FROM b.unit AND a.year IS NOT DISTINCT FROM b.year)
    SELECT coalesce(ab.unit, c.unit) AS unit, year, n, q, seg FROM ab FULL JOIN c ON ab.unit IS NOT DISTINCT FROM c.unit"""
)
def q_outer_combine3(spark, d):
    a = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    b = _t(spark, d, "lineitem").groupBy(F.nullif(F.col("l_suppkey") % 500, F.lit(7)).alias("unit"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"))
    c = _t(spark, d, "customer").select(F.nullif("c_custkey", F.lit(9)).alias("unit"), F.col("c_mktsegment").alias("seg"))
    return panel.combine([a, b, c], ["unit", "year"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, coalesce(s.v, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) s ON o_custkey = c_custkey")
def q_update_merge(spark, d):
    new = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return panel.fill(panel.update_merge(_t(spark, d, "customer"), new, ["c_custkey"]), {"acctbal": 0.0}, "c_")


@query(
    """SELECT l_partkey AS pixel, l_orderkey AS k, l_linenumber AS ln, CASE WHEN p_size > 25 THEN nullif(l_discount, 0) END AS v, CASE WHEN p_size > 25 THEN nullif(l_tax, 0) END AS w
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND (l_discount <> 0 OR l_tax <> 0)"""
)
def q_landmask_drop(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), values.positive(F.col("l_discount")).alias("v"), values.positive(F.col("l_tax")).alias("w"))
    mask = _t(spark, d, "part").select(F.col("p_partkey").alias("pixel"), (F.col("p_size") > 25).alias("land"))
    return panel.keep_where_any(li, ["pixel"], mask, "land", ["v", "w"])


# --- zonal, resampling, time --------------------------------------------------


@query("SELECT n_regionkey AS zone, round(avg(c_acctbal), 4) AS v_mean, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 4) AS v_sum, min(c_acctbal) AS v_min, max(c_acctbal) AS v_max, count(*) AS v_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def q_zonal_mean(spark, d):
    z = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("zone"), F.col("c_acctbal").alias("v"))
    return stats.zonal(z, ["zone"], "v", ["mean", "sum", "min", "max", "count"]).select("zone", _r("v_mean"), F.round("v_sum", 4).alias("v_sum"), "v_min", "v_max", "v_count")


@query("SELECT c_nationkey AS zone, round(median(c_acctbal), 4) AS v_median, round(stddev_samp(c_acctbal), 4) AS v_std, round(var_samp(c_acctbal), 2) AS v_var, arg_min(c_acctbal, c_custkey) AS v_first, arg_max(c_acctbal, c_custkey) AS v_last FROM customer GROUP BY 1")
def q_zonal_holistic(spark, d):
    z = _t(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("o"))
    return stats.zonal(z, ["zone"], "v", ["median", "std", "var", "first", "last"], order="o").select("zone", _r("v_median"), _r("v_std"), _r("v_var", 2), "v_first", "v_last")


_RASTER = "(SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, year(l_shipdate)::INTEGER AS year, l_quantity AS q, l_discount AS v FROM lineitem)"


def _raster(spark, d):
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("r"), (F.col("l_partkey") % 64).alias("c"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("v"))


@query(f"WITH n AS (SELECT year, r // 8 AS row, c // 8 AS col, q, count(*) AS n FROM {_RASTER} GROUP BY ALL) SELECT year, row, col, q FROM n QUALIFY row_number() OVER (PARTITION BY year, row, col ORDER BY n DESC, q) = 1")
def q_downsample_mode(spark, d):
    return spatial.resample(_raster(spark, d), "r", "c", 8, ["q"], "mode", ("year",))


@query(f"SELECT year, r // 8 AS row, c // 8 AS col, round(avg(q), 6) AS q, round(avg(v), 6) AS v FROM {_RASTER} GROUP BY ALL")
def q_downsample_avg(spark, d):
    return spatial.resample(_raster(spark, d), "r", "c", 8, ["q", "v"], "average", ("year",)).select("year", "row", "col", _r("q", 6), _r("v", 6))


_DAILY = "(SELECT user_id AS pixel, ts, CAST(ts AS DATE) AS day, CASE WHEN value * 100 + 22000 BETWEEN 20000 AND 35000 THEN value * 100 + 22000 END AS lst, event_id FROM events)"


def _daily(spark, d):
    e = _t(spark, d, "events")
    v = values.valid_range(F.col("value") * 100 + 22000, 20000, 35000)
    return e.select(F.col("user_id").alias("pixel"), "ts", F.to_date("ts").alias("day"), v.alias("lst"), "event_id")


@query(
    """WITH c AS (SELECT l_orderkey % 48 AS r, l_partkey % 48 AS c, l_orderkey AS k, l_linenumber AS ln, l_extendedprice AS v FROM lineitem),
    b AS (SELECT x, y, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM c, range(3) AS i(x), range(3) AS j(y) WHERE r BETWEEN 16 * x - 3 AND 16 * x + 18 AND c BETWEEN 16 * y - 3 AND 16 * y + 18 GROUP BY ALL)
    SELECT k, ln, round(least(greatest(v, lo), hi), 4) AS v FROM c JOIN b ON b.x = r // 16 AND b.y = c.c // 16"""
)
def q_winsorize_halo(spark, d):
    """Clipped to the quantiles of a tile of 16 x 16 cells and of the 3 cells around it."""
    li = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 48).alias("r"), (F.col("l_partkey") % 48).alias("c"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_extendedprice").alias("v"))
    return spatial.winsorize_tiles(li, "r", "c", 16, ["v"], 0.05, pad=3).select("k", "ln", _r("v"))


@query(
    f"""SELECT pixel, year(day)::INTEGER AS year, round(avg(lst), 4) AS mean, round(median(lst), 4) AS median, round(stddev_pop(lst), 4) AS std, round(max(lst), 4) AS max, round(min(lst), 4) AS min,
    count_if(lst > 30315)::BIGINT AS n_hot, count_if(lst < 27315)::BIGINT AS n_cold, count(lst) AS n_valid FROM {_DAILY} GROUP BY ALL"""
)
def q_annual_stats(spark, d):
    s = stats.annual_stats(_daily(spark, d).withColumn("year", F.year("day")), ["pixel", "year"], "lst", 30315, 27315)
    return s.select("pixel", "year", *[_r(c) for c in ("mean", "median", "std", "max", "min")], "n_hot", "n_cold", "n_valid")


@query(f"SELECT pixel, date_trunc('month', day)::DATE AS month, round(avg(lst), 4) AS lst_mean, round(median(lst), 4) AS lst_median, round(stddev_pop(lst), 4) AS lst_std, count(lst) AS lst_count FROM {_DAILY} GROUP BY ALL")
def q_monthly_stats(spark, d):
    m = _daily(spark, d).withColumn("month", F.trunc("day", "month"))
    return stats.zonal(m, ["pixel", "month"], "lst", ["mean", "median", "std", "count"], ddof=0).select("pixel", "month", _r("lst_mean"), _r("lst_median"), _r("lst_std"), "lst_count")


@query(
    f"""WITH r AS (SELECT pixel, year(day)::INTEGER AS year, CASE WHEN count(lst) OVER w = 3 THEN avg(lst) OVER w END AS m FROM {_DAILY} WINDOW w AS (PARTITION BY pixel ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT pixel, year, round(max(m), 4) AS roll_max, round(min(m), 4) AS roll_min FROM r GROUP BY ALL"""
)
def q_rolling3_extrema(spark, d):
    return stats.rolling_extrema(_daily(spark, d).withColumn("year", F.year("day")), ["pixel", "year"], "pixel", "event_id", "lst").select("pixel", "year", _r("roll_max"), _r("roll_min"))


@query(f"SELECT unit, year, round(y, 4) AS y, x, round(lag(y) OVER w, 4) AS y_lag, round(y - lag(y) OVER w, 4) AS y_diff FROM ({_PANEL}) WINDOW w AS (PARTITION BY unit ORDER BY year)")
def q_lag_diff(spark, d):
    return stats.lags(_panel(spark, d), ["unit"], ["year"], ["y"]).select("unit", "year", _r("y"), "x", _r("y_lag"), _r("y_diff"))


@query(f"SELECT unit, year, round(y - avg(y) OVER (PARTITION BY unit), 4) AS y_within FROM ({_PANEL})")
def q_within(spark, d):
    return stats.within(_panel(spark, d), ["unit"], ["y"]).select("unit", "year", _r("y_within"))


@query(f"WITH u AS (SELECT unit, year, y - avg(y) OVER (PARTITION BY unit) AS y FROM ({_PANEL})) SELECT unit, year, round(y - avg(y) OVER (PARTITION BY year), 4) AS y_twoway_demeaned FROM u")
def q_twoway_demean(spark, d):
    return stats.twoway_demean(_panel(spark, d), "unit", "year", ["y"]).select("unit", "year", _r("y_twoway_demeaned"))


@query(f"SELECT unit, year, round(avg(x) OVER (PARTITION BY unit), 6) AS x_mean_unit, round(avg(x) OVER (PARTITION BY year), 6) AS x_mean_year FROM ({_PANEL})")
def q_mundlak_means(spark, d):
    p = stats.group_means(stats.group_means(_panel(spark, d), ["unit"], ["x"]), ["year"], ["x"])
    return p.select("unit", "year", _r("x_mean_unit", 6), _r("x_mean_year", 6))


# --- intervals, classes -------------------------------------------------------

_SITES = "(SELECT p_partkey AS site, p_brand AS brand, 1992 + p_partkey % 20 AS y0, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 1990 + p_partkey % 20 + p_size % 9 END AS y1 FROM part)"


def _sites(spark, d):
    y = F.col("p_partkey") % 20
    return _t(spark, d, "part").select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("brand"), (1992 + y).alias("y0"), F.when(F.col("p_size") % 4 != 0, 1990 + y + F.col("p_size") % 9).alias("y1"))


@query(f"SELECT site, unnest(range(greatest(y0, 1995), least(coalesce(y1, 2010), 2010) + 1))::INTEGER AS year FROM {_SITES}")
def q_interval_expand(spark, d):
    return panel.explode_years(_sites(spark, d), F.col("y0"), F.col("y1"), 1995, 2010).select("site", "year")


@query(f"SELECT brand, year, count(*) AS n_active FROM (SELECT brand, unnest(range(greatest(y0, 1995), least(coalesce(y1, 2010), 2010) + 1))::INTEGER AS year FROM {_SITES}) GROUP BY ALL")
def q_active_counts(spark, d):
    return panel.active_counts(_sites(spark, d), ["brand"], "y0", "y1", 1995, 2010)


@query(
    f"""WITH s AS (SELECT brand, y0, coalesce(y1, 2012) AS y1, site FROM {_SITES}), g AS (SELECT brand, year FROM (SELECT DISTINCT brand FROM s), (SELECT unnest(range(1992, 2013))::INTEGER AS year))
    SELECT g.brand, g.year, min(site) AS first_site FROM g LEFT JOIN s ON s.brand = g.brand AND g.year BETWEEN y0 AND y1 GROUP BY ALL"""
)
def q_interval_first_match(spark, d):
    s = _sites(spark, d).withColumn("y1", F.coalesce("y1", F.lit(2012))).withColumn("first_site", F.col("site"))
    years = spark.range(1992, 2013).select(F.col("id").cast("int").alias("year"))
    points = s.select("brand").distinct().join(F.broadcast(years))
    return panel.first_match(points, s, "brand", "year", "y0", "y1", "site", ["first_site"])


_HIST = "(SELECT c_nationkey AS k, 1985 + c_custkey % 35 AS year, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v, c_custkey AS id FROM customer)"


@query(
    f"""WITH h AS (SELECT k, year, avg(v) AS v FROM {_HIST} GROUP BY ALL)
    SELECT k, round(arg_max(v, year) FILTER (v IS NOT NULL AND year <= 1991), 4) AS v_1991, round(arg_max(v, year) FILTER (v IS NOT NULL AND year <= 1999), 4) AS v_1999, round(arg_max(v, year) FILTER (v IS NOT NULL AND year <= 2011), 4) AS v_2011 FROM h GROUP BY k"""
)
def q_asof_last_nonnull(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), (1985 + F.col("c_custkey") % 35).alias("year"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("v"))
    h = c.groupBy("k", "year").agg(F.avg("v").alias("v"))
    return panel.last_known(h, ["k"], "year", ["v"], [1991, 1999, 2011]).select("k", _r("v_1991"), _r("v_1999"), _r("v_2011"))


@query(
    """WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 0.5 + n_nationkey / 60.0 END::DOUBLE AS v FROM nation),
    l AS (SELECT k, CASE WHEN v IS NULL THEN NULL WHEN v < 0.55 THEN 'LO' WHEN v < 0.70 THEN 'ME' WHEN v < 0.80 THEN 'HI' ELSE 'VH' END AS class FROM c)
    SELECT k, class, coalesce(class = 'LO', false) AS is_LO, coalesce(class = 'ME', false) AS is_ME, coalesce(class = 'HI', false) AS is_HI, coalesce(class = 'VH', false) AS is_VH FROM l"""
)
def q_classify_wide(spark, d):
    c = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 6 != 5, 0.5 + F.col("n_nationkey") / 60).alias("v"))
    l = c.withColumn("class", values.classify(F.col("v"), [(0.55, "LO"), (0.70, "ME"), (0.80, "HI")], "VH"))
    return l.select("k", "class", *values.dummies(F.col("class"), ["LO", "ME", "HI", "VH"], "is_"))


@query("SELECT p_partkey AS k, p_type AS label, coalesce(r, 0)::INTEGER AS code FROM part LEFT JOIN (SELECT p_type AS t, row_number() OVER (ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type FROM part)) ON t = p_type")
def q_dict_encode(spark, d):
    return panel.encode_labels(_t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("label")), "label")


@query("SELECT n_nationkey AS k, m AS measure, v::DOUBLE AS v FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS b FROM nation) UNPIVOT (v FOR m IN (a, b))")
def q_melt(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("double").alias("a"), (F.col("n_nationkey") * 2).cast("double").alias("b"))
    return n.unpivot("k", ["a", "b"], "measure", "v")


# --- catalogue and text -------------------------------------------------------

_STATUS = "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'DOWNLOADING' WHEN 2 THEN 'FAILED: timeout' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'pending' WHEN 5 THEN '' ELSE 'completed' END"
_CAT_OF = "CASE WHEN s IS NULL OR s IN ('', 'pending') THEN 'pending' WHEN s = 'DOWNLOADING' THEN 'downloading' WHEN s LIKE 'FAILED:%' THEN 'failed' WHEN s = 'completed' THEN 'completed' ELSE 'other' END"
_CATALOG = f"""(SELECT md5('http://host/' || doc_id) AS h, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS size, s, {_CAT_OF} AS cat, (1990 + doc_id % 30)::INTEGER AS year, (1 + doc_id % 365)::INTEGER AS doy, doc_id
    FROM (SELECT doc_id, n_chars, {_STATUS} AS s FROM documents))"""


def _catalog(spark, d):
    doc = F.col("doc_id")
    m = doc % 9
    status = F.when(m == 1, "DOWNLOADING").when(m == 2, "FAILED: timeout").when(m == 3, "FAILED").when(m == 4, "pending").when(m == 5, "").when(m > 5, "completed")
    name = F.format_string("P06.V01.A%d%03d.h%02dv%02d.2022021.hdf", 1990 + doc % 30, 1 + doc % 365, doc % 36, doc % 18)
    files = _t(spark, d, "documents").select(
        F.concat(F.lit("http://host/"), doc.cast("string")).alias("source_url"), name.alias("relative_path"), F.when(doc % 11 != 0, F.col("n_chars")).alias("file_size"), status.alias("download_status")
    )
    return catalog.build(files)


_CAT_COUNTS = ", ".join(f"count_if(cat = '{s}')::BIGINT AS n_{s}" for s in ("pending", "downloading", "failed", "completed", "other"))


@query(f"SELECT count(*) AS n_files, {_CAT_COUNTS}, coalesce(sum(size), 0)::BIGINT AS bytes, count(DISTINCT year) AS n_years, min(year) AS min_year, max(year) AS max_year FROM {_CATALOG}")
def q_catalog_stats(spark, d):
    return catalog.totals(_catalog(spark, d))


@query("SELECT n_nationkey AS k, coalesce(bool_or(c_mktsegment = 'BUILDING'), false) AS \"BUILDING\", coalesce(bool_or(c_mktsegment = 'MACHINERY'), false) AS \"MACHINERY\" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def q_wide_flags_all(spark, d):
    """As `q_wide_flags`; tests hold it against brute force."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment")
    return panel.wide_flags(c, "k", "c_mktsegment", ["BUILDING", "MACHINERY"], _t(spark, d, "nation").select(F.col("n_nationkey").alias("k")))


@query(f"SELECT year, count(*) AS n_files, {_CAT_COUNTS}, coalesce(sum(size), 0)::BIGINT AS bytes, round(avg(size), 4) AS mean_size FROM {_CATALOG} GROUP BY year")
def q_catalog_by_year(spark, d):
    c = catalog.by_year(_catalog(spark, d))
    return c.withColumn("mean_size", F.round("mean_size", 4))


@query(f"SELECT h AS file_hash, size AS file_size, year FROM {_CATALOG} WHERE cat IN ('pending') ORDER BY size ASC NULLS LAST, h LIMIT 50")
def q_pending_topk(spark, d):
    return catalog.pending(_catalog(spark, d), 50).select("file_hash", "file_size", "year")


@query(f"SELECT h AS file_hash, size AS file_size, year FROM {_CATALOG} WHERE cat IN ('pending', 'failed') ORDER BY size ASC NULLS LAST, h LIMIT 50")
def q_pending_topk_retry(spark, d):
    return catalog.pending(_catalog(spark, d), 50, retry_failed=True).select("file_hash", "file_size", "year")


@query(
    f"""WITH c AS (SELECT * FROM {_CATALOG}), u AS (SELECT h, CASE WHEN doc_id % 4 = 0 THEN 'completed' ELSE 'strange' END AS s2 FROM c WHERE doc_id % 2 = 0)
    SELECT c.h AS file_hash, coalesce(u.s2, c.s) AS download_status, CASE WHEN u.s2 = 'completed' THEN 'completed' ELSE c.cat END AS status_category FROM c LEFT JOIN u USING (h)"""
)
def q_status_update(spark, d):
    c = _catalog(spark, d)
    doc = F.regexp_extract("source_url", r"(\d+)$", 1).cast("long")
    hit = c.filter(doc % 2 == 0)
    first = hit.select("file_hash", F.lit("DOWNLOADING").alias("download_status"), F.lit(1).alias("ordinal"))
    second = hit.select("file_hash", F.when(doc % 4 == 0, "completed").otherwise("strange").alias("download_status"), F.lit(2).alias("ordinal"))
    return catalog.update_status(c, first.union(second)).select("file_hash", "download_status", "status_category")


@query(f"WITH c AS (SELECT h, size, doc_id FROM {_CATALOG}) SELECT h AS file_hash, CASE WHEN doc_id % 5 = 0 THEN 1::BIGINT ELSE size END AS file_size FROM c UNION ALL SELECT md5('new' || doc_id), size FROM c WHERE doc_id % 5 = 0")
def q_catalog_upsert(spark, d):
    c = _catalog(spark, d).withColumn("doc", F.regexp_extract("source_url", r"(\d+)$", 1).cast("long")).select("file_hash", "file_size", "doc")
    part = c.filter("doc % 5 = 0")
    incoming = part.withColumn("file_size", F.lit(1).cast("long")).unionByName(part.withColumn("file_hash", F.md5(F.concat(F.lit("new"), F.col("doc").cast("string")))))
    return panel.upsert(c, incoming, "file_hash").select("file_hash", "file_size")


@query(f"SELECT DISTINCT year, doy AS day_of_year FROM {_CATALOG} WHERE (year, doy) NOT IN (SELECT (year, doy) FROM {_CATALOG} WHERE cat = 'completed')")
def q_missing_entrypoints(spark, d):
    c = _catalog(spark, d)
    return panel.missing_keys(c.select("year", "day_of_year").distinct(), c.filter("status_category = 'completed'"), ["year", "day_of_year"])


@query(
    """SELECT doc_id AS k, (1990 + doc_id % 30)::INTEGER AS year, (1 + doc_id % 365)::INTEGER AS day, (doc_id % 36)::INTEGER AS h, (doc_id % 18)::INTEGER AS v,
    (make_date((1990 + doc_id % 30)::INTEGER, 1, 1) + (doc_id % 365)::INTEGER)::DATE AS date FROM documents"""
)
def q_filename_parse(spark, d):
    doc = F.col("doc_id")
    name = F.format_string("P06.V01.A%d%03d.h%02dv%02d.2022021.hdf", 1990 + doc % 30, 1 + doc % 365, doc % 36, doc % 18)
    parts = text.tile_file(F.col("name"))
    return _t(spark, d, "documents").select(doc.alias("k"), name.alias("name")).select("k", *[c.alias(n) for n, c in parts.items()], text.day_of_year(parts["year"], parts["day"]).alias("date"))


@query(
    """WITH t AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '(Jan ' || (1990 + p_size) || ')  opened   ' || p_name || ' (Q3 2001) closed' END AS t FROM part)
    SELECT k, seq::INTEGER AS seq, date, text FROM (SELECT k, generate_subscripts(regexp_extract_all(t, '\\(([^)]+)\\)\\s*([^(]*)', 1), 1) AS seq, unnest(regexp_extract_all(t, '\\(([^)]+)\\)\\s*([^(]*)', 1)) AS date,
      trim(regexp_replace(unnest(regexp_extract_all(t, '\\(([^)]+)\\)\\s*([^(]*)', 2)), '\\s+', ' ', 'g')) AS text FROM t)
    UNION ALL SELECT k, 1, NULL, t FROM t WHERE NOT regexp_matches(t, '\\(')""".replace("\\\\", "\\")
)
def q_event_segments(spark, d):
    t = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("(Jan "), (1990 + F.col("p_size")).cast("string"), F.lit(")  opened   "), F.col("p_name"), F.lit(" (Q3 2001) closed")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(text.segments(t)).alias("s")).select("k", "s.seq", "s.date", "s.text")


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN -abs(round(c_acctbal, 2)) WHEN 1 THEN round(c_acctbal, 2) WHEN 2 THEN NULL ELSE (c_custkey % 100) / 1.0 END::DOUBLE AS v FROM customer"""
)
def q_number_parse(spark, d):
    bal = F.format_string("%.2f", F.col("c_acctbal"))
    m = F.col("c_custkey") % 4
    comma = F.replace(bal, F.lit("."), F.lit(","))
    written = F.when(m == 0, F.concat(F.lit("("), F.replace(comma, F.lit("-"), F.lit("")), F.lit(")"))).when(m == 1, F.concat(F.lit(" "), comma)).when(m == 2, " NA ").otherwise((F.col("c_custkey") % 100).cast("string"))
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.written_number(written).alias("v"))


@query(
    """WITH s AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, (o_totalprice::BIGINT)::DOUBLE AS v, o_orderkey % 5 > 0 AS ok FROM orders)
    SELECT method, dataset, count(*) AS n, sum(v) AS total, round(avg(v), 4) AS mean, median(v) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, min(v) AS min, max(v) AS max, count_if(ok)::BIGINT AS n_success, count_if(NOT ok)::BIGINT AS n_failed FROM s GROUP BY ALL"""
)
def q_runtime_summary(spark, d):
    seconds = F.bround(F.col("o_totalprice"), 0).cast("long")
    stamp = text.duration_text(seconds)
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("dataset"), text.duration_seconds(stamp).cast("double").alias("v"), (F.col("o_orderkey") % 5 > 0).alias("ok"))
    return stats.summary(o, ["method", "dataset"], "v", F.col("ok")).withColumn("mean", F.round("mean", 4))


@query("SELECT event_id AS k, (s // 86400) || format('-{:02d}:{:02d}:{:02d}', s // 3600 % 24, s // 60 % 60, s % 60) AS txt, s FROM (SELECT event_id, (abs(value) * 1000)::BIGINT AS s FROM events)")
def q_durations(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("k"), F.bround(F.abs("value") * 1000).cast("long").alias("s"))
    t = e.withColumn("txt", text.duration_text(F.col("s")))
    return t.select("k", "txt", text.duration_seconds(F.col("txt")).alias("s"))


# --- distributions and sequences ---------------------------------------------


@query(
    """WITH b AS (SELECT greatest(0, least(9, floor((l_quantity - 0) / 5)))::INTEGER AS bx, greatest(0, least(4, floor((l_discount - 0) / 0.02)))::INTEGER AS by, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT x.i::INTEGER AS bx, y.i::INTEGER AS by, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM b), 6) AS share FROM range(10) x(i), range(5) y(i) LEFT JOIN b ON b.bx = x.i AND b.by = y.i"""
)
def q_hist2d(spark, d):
    return stats.histogram_2d(_t(spark, d, "lineitem"), "l_quantity", "l_discount", (0.0, 50.0, 10), (0.0, 0.1, 5)).withColumn("share", F.round("share", 6))


@query("SELECT c_nationkey, " + ", ".join(f"count_if(c_mktsegment = '{s}')::BIGINT AS n_{s}" for s in ("BUILDING", "MACHINERY", "HOUSEHOLD")) + ", count(*) AS n_all FROM customer GROUP BY 1")
def q_pivot_counts(spark, d):
    return stats.pivot_counts(_t(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"])


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def q_corr(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run"""
)
def q_islands(spark, d):
    return stats.islands(_t(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query(
    f"""WITH p AS (SELECT unit, year, y / 1000 AS y FROM ({_PANEL})), s AS (SELECT unit, year, count(y) OVER r AS k, sum(y) OVER r AS s, sum(y * y) OVER r AS q, count(y) OVER e AS n, sum(y) OVER e AS t, sum(y * y) OVER e AS tq FROM p
      WINDOW r AS (PARTITION BY unit ORDER BY year ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY unit)),
    f AS (SELECT unit, year, round(q - s * s / k + (tq - q) - (t - s) * (t - s) / (n - k), 4) AS sse, (t - s) / (n - k) - s / k AS shift FROM s WHERE k >= 2 AND n - k >= 2)
    SELECT unit, arg_min(year, (sse, year)) AS split_after, round(min(sse), 2) AS sse, round(arg_min(shift, (sse, year)), 4) AS shift FROM f GROUP BY unit"""
)
def q_changepoint(spark, d):
    p = _panel(spark, d).select("unit", "year", (F.col("y") / 1000).alias("y"))
    return stats.changepoint(p, ["unit"], "year", "y").select("unit", "split_after", _r("sse", 2), _r("shift"))


@query(
    """WITH p AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, [0.01, 0.25, 0.5, 0.75, 0.99]) AS p FROM customer GROUP BY 1)
    SELECT c_custkey AS k, (v < p[1] OR v > p[5]) AS beyond_quantile, (v < p[3] - 1.5 * (p[4] - p[2]) OR v > p[3] + 1.5 * (p[4] - p[2])) AS beyond_iqr FROM (SELECT c_custkey, c_nationkey AS g, c_acctbal AS v FROM customer) JOIN p USING (g)"""
)
def q_outlier_flags(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    return stats.outlier_flags(c, ["g"], "v").select("k", "beyond_quantile", "beyond_iqr")


@query(f"SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 4) AS mean_size, median(n)::DOUBLE AS median_size, count(*) < 50 AS few_clusters, max(n) > 10 * avg(n) AS uneven FROM (SELECT unit, count(*) AS n FROM ({_PANEL}) GROUP BY 1)")
def q_cluster_diag(spark, d):
    return stats.cluster_sizes(_panel(spark, d), "unit").withColumn("mean_size", F.round("mean_size", 4))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, lag(event_id) OVER w AS a FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, a AS started, event_id AS completed FROM e WHERE event_type = 'error' AND p = 'click'"""
)
def q_event_pairs(spark, d):
    return stats.pair_events(_t(spark, d, "events"), "user_id", "event_id", "event_type", "click", "error")


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_event_windows(spark, d):
    from panelspark.streaming.online import windowed_counts

    out = windowed_counts(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", value="value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", _r("total"))


# --- geometry -----------------------------------------------------------------

_RINGS = {0: [(0, 0), (40, 0), (40, 40), (0, 40)], 1: [(20, 20), (70, 20), (70, 60), (20, 60)], 2: [(50, 0), (95, 0), (95, 50), (80, 50), (80, 15), (50, 15)]}


def _polygons(spark):
    rows = [(str(k), [{"x": float(x), "y": float(y)} for x, y in ring], k) for k, ring in _RINGS.items()]
    return spark.createDataFrame(rows, "id string, ring array<struct<x:double,y:double>>, ordinal int")


def _points(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k.alias("k"), ((k * 37) % 997 / 10.0 + 0.013).alias("x"), ((k * 91) % 613 / 10.0 + 0.017).alias("y"))


_POINTS = "(SELECT o_orderkey AS k, (o_orderkey * 37) % 997 / 10.0::DOUBLE + 0.013 AS x, (o_orderkey * 91) % 613 / 10.0::DOUBLE + 0.017 AS y FROM orders)"
_EDGES = ", ".join(f"('{k}', {i}, {ring[i][0]}.0, {ring[i][1]}.0, {ring[i - 1][0]}.0, {ring[i - 1][1]}.0)" for k, ring in _RINGS.items() for i in range(len(ring)))
_PIP = f"""SELECT k, id FROM (SELECT k, id, sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) AS c
    FROM {_POINTS}, (VALUES {_EDGES}) e(id, i, ax, ay, bx, by_) GROUP BY k, id) WHERE c % 2 = 1"""


@query(_PIP)
def q_pip_join(spark, d):
    return spatial.point_in_polygon(_points(spark, d), _polygons(spark), "x", "y", 10.0).select("k", "id")


@query(f"SELECT k, max(id) AS id FROM ({_PIP}) GROUP BY k")
def q_pip_last_wins(spark, d):
    return spatial.point_in_polygon(_points(spark, d), _polygons(spark), "x", "y", 10.0, overlap="last", key=["k"]).select("k", "id")


@query(
    f"""WITH p AS (SELECT * FROM {_POINTS}), s AS (SELECT s_suppkey AS s, (s_suppkey * 53 % 100)::DOUBLE AS sx, (s_suppkey * 29 % 62)::DOUBLE AS sy FROM supplier)
    SELECT p.k, count(s) AS n_sites FROM p LEFT JOIN s ON (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 25 GROUP BY p.k"""
)
def q_buffer_count(spark, d):
    s = F.col("s_suppkey")
    sites = _t(spark, d, "supplier").select(s.alias("s"), (s * 53 % 100).cast("double").alias("sx"), (s * 29 % 62).cast("double").alias("sy"))
    return spatial.buffer_counts(_points(spark, d), sites, ("x", "y"), ("sx", "sy"), 5.0, "k").select("k", "n_sites").distinct()


@query()
def q_buffer_count_all(spark, d):
    """As `q_buffer_count`; tests hold it against brute force."""
    return q_buffer_count(spark, d)


@query(
    f"""WITH p AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 101)::DOUBLE AS x, (o_orderkey * 91 % 67)::DOUBLE AS y FROM orders)
    SELECT k, id FROM p, (VALUES {_EDGES}) e(id, i, ax, ay, bx, by_) GROUP BY k, id
    HAVING sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1
      OR bool_or((bx - ax) * (y - ay) = (by_ - ay) * (x - ax) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_))"""
)
def q_pip_boundary(spark, d):
    """Points of a whole-numbered grid in polygons of whole-numbered corners: those on an edge count."""
    k = F.col("o_orderkey")
    pts = _t(spark, d, "orders").select(k.alias("k"), (k * 37 % 101).cast("double").alias("x"), (k * 91 % 67).cast("double").alias("y"))
    return spatial.point_in_polygon(pts, _polygons(spark), "x", "y", 10.0, boundary=True).select("k", "id")


@query(
    """WITH s AS (SELECT DISTINCT c_nationkey AS id, y.range AS year FROM customer, range(1993, 1997) y), a AS (SELECT c_nationkey AS id, year(o_orderdate) AS year, count(*)::DOUBLE AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    b AS (SELECT c_nationkey AS id, 1990 + c_custkey % 9 AS year, sum(c_custkey)::DOUBLE AS keys FROM customer WHERE c_nationkey < 9 GROUP BY ALL)
    SELECT id, year::BIGINT AS year, coalesce(n, 0) AS n, coalesce(keys, 0) AS keys FROM s FULL JOIN a USING (id, year) FULL JOIN b USING (id, year)"""
)
def q_seeded_frame(spark, d):
    """Nations and years as a seed; counts of orders and sums of keys join it, and bring rows of their own."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("id"))
    seed = c.select("id").distinct().withColumn("year", F.explode(F.sequence(F.lit(1993), F.lit(1996)))).withColumn("year", F.col("year").cast("long"))
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").cast("long").alias("year"))
    a = orders.join(c, "key").groupBy("id", "year").agg(F.count(F.lit(1)).cast("double").alias("n"))
    b = c.filter("id < 9").groupBy("id", (F.lit(1990) + F.col("key") % 9).cast("long").alias("year")).agg(F.sum("key").cast("double").alias("keys"))
    return panel.seeded(seed, [a, b], ["id", "year"])


#: Corners of a supplier's area, from its place (x0, y0) and two numbers of its own (u, w).
_CORNERS = [("0.0", "0.0"), ("3.3 + u", "0.7"), ("1.9", "1.6"), ("4.1", "3.9 + w"), ("-1.6", "2.4")]


def _areas(spark, d):
    s = F.col("s_suppkey")
    base = _t(spark, d, "supplier").select(s.alias("id"), (s % 5).alias("year"), (s * 53 % 100 + F.lit(0.137)).alias("x0"), (s * 29 % 62 + F.lit(0.211)).alias("y0"), (s % 4).cast("double").alias("u"), (s % 3).cast("double").alias("w"))
    number = lambda c: F.expr(re.sub(r"(\d+\.\d+)", r"\1D", c))
    ring = F.array(*[F.struct((F.col("x0") + number(x)).alias("x"), (F.col("y0") + number(y)).alias("y")) for x, y in _CORNERS])
    return base.select("id", "year", ring.alias("ring"), F.col("id").alias("ordinal"))


_AREAS = f"""base AS (SELECT s_suppkey AS id, s_suppkey % 5 AS year, (s_suppkey * 53 % 100) + 0.137::DOUBLE AS x0, (s_suppkey * 29 % 62) + 0.211::DOUBLE AS y0, (s_suppkey % 4)::DOUBLE AS u, (s_suppkey % 3)::DOUBLE AS w FROM supplier),
    corners AS ({" UNION ALL ".join(f"SELECT id, year, {i} AS i, x0 + ({x})::DOUBLE AS x, y0 + ({y})::DOUBLE AS y FROM base" for i, (x, y) in enumerate(_CORNERS))}),
    edges AS (SELECT a.id, a.year, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM corners a JOIN corners b ON b.id = a.id AND b.i = (a.i + {len(_CORNERS) - 1}) % {len(_CORNERS)}),
    boxes AS (SELECT id, floor(min(x))::BIGINT AS x0, floor(max(x))::BIGINT AS x1, floor(min(y))::BIGINT AS y0, floor(max(y))::BIGINT AS y1 FROM corners GROUP BY id),
    cells AS (SELECT id, col, unnest(range(y0, y1 + 1)) AS row FROM (SELECT *, unnest(range(x0, x1 + 1)) AS col FROM boxes)),
    centres AS (SELECT c.id, row, col FROM cells c JOIN edges e USING (id) GROUP BY c.id, row, col
      HAVING sum(CASE WHEN (ay > row + 0.5) <> (by_ > row + 0.5) AND col + 0.5 < (bx - ax) * (row + 0.5 - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1)"""


def _clip(low: str, high: str, a: str, b: str) -> tuple[str, str]:
    """The part of a segment's way from a (0) to b (1) in which a coordinate is between low and high, as SQL."""
    at = lambda v: f"({v} - {a}) / nullif({b} - {a}, 0)"
    flat = f"CASE WHEN {a} BETWEEN {low} AND {high} THEN"
    return f"coalesce(least({at(low)}, {at(high)}), {flat} 0 ELSE 2 END)", f"coalesce(greatest({at(low)}, {at(high)}), {flat} 1 ELSE -1 END)"


def _through(x0: str, x1: str, y0: str, y1: str) -> str:
    """Whether an edge (ax, ay, bx, by_) has a point in a box, as SQL."""
    (s, t), (u, v) = _clip(x0, x1, "ax", "bx"), _clip(y0, y1, "ay", "by_")
    return f"greatest({s}, {u}, 0) <= least({t}, {v}, 1)"


@query(f"WITH {_AREAS} SELECT row, col, id FROM centres")
def q_rasterize_centres(spark, d):
    """Cells whose centre lies in a supplier's area."""
    return polygons.rasterize(_areas(spark, d), 1.0).select("row", "col", "id")


@query(f"WITH {_AREAS}, touched AS (SELECT DISTINCT c.id, row, col FROM cells c JOIN edges e USING (id) WHERE {_through('col', 'col + 1', 'row', 'row + 1')}) SELECT row, col, max(id) AS id FROM (FROM touched UNION SELECT id, row, col FROM centres) GROUP BY row, col")
def q_rasterize_touched(spark, d):
    """Cells that a supplier's area touches, the later supplier first."""
    return polygons.rasterize(_areas(spark, d), 1.0, all_touched=True, overlap="last")


_COARSE = "(SELECT year, r, c, avg(q) AS v FROM (SELECT year(l_shipdate)::INTEGER AS year, l_orderkey % 40 AS r, l_partkey % 50 AS c, l_quantity AS q FROM lineitem) GROUP BY ALL HAVING count(*) < 9)"


@query(
    f"""WITH s AS {_COARSE}, t AS (SELECT i // 70 AS row, i % 70 AS col, 0.3::DOUBLE + (i // 70) * 0.65::DOUBLE AS y, 1.1::DOUBLE + (i % 70) * 0.71::DOUBLE AS x FROM range(4200) k(i)),
    n AS (SELECT row, col, floor(y)::BIGINT + a AS r, floor(x)::BIGINT + b AS c, (1 - abs(y - floor(y) - a)) * (1 - abs(x - floor(x) - b)) AS w FROM t, range(2) p(a), range(2) q(b))
    SELECT year, row, col, round(sum(w * v) / sum(w), 8) AS v FROM n JOIN s USING (r, c) GROUP BY year, row, col HAVING sum(w) > 1e-9"""
)
def q_warp_bilinear(spark, d):
    """A grid of 40 x 50 cells with holes on one of 60 x 70, each year."""
    li = _t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), (F.col("l_orderkey") % 40).alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_quantity").alias("q"))
    means = li.groupBy("year", "row", "col").agg(F.avg("q").alias("v"), F.count(F.lit(1)).alias("n")).filter("n < 9")
    out = warp.warp(means, grid.GridSpec(0, 0, 1, 1, 40, 50), grid.GridSpec(0.3, 1.1, 0.65, 0.71, 60, 70), ["v"], by=("year",))
    return out.select("year", "row", "col", _r("v", 8))


@query(
    f"""WITH {_AREAS}, spells AS (SELECT l_suppkey AS id, year(l_shipdate) AS a, CASE WHEN l_linenumber % 3 > 0 THEN year(l_shipdate) + l_linenumber END AS b FROM lineitem WHERE l_quantity > 45),
    active AS (SELECT id, y.range::INTEGER AS year, count(*) AS n FROM spells JOIN range(1994, 1999) y ON a <= y.range AND (b IS NULL OR b >= y.range) GROUP BY ALL)
    SELECT row, col, year, sum(n)::BIGINT AS n FROM centres JOIN active USING (id) GROUP BY ALL"""
)
def q_indicator_grid(spark, d):
    """How many spells the suppliers over a cell have in each year."""
    li = _t(spark, d, "lineitem").filter("l_quantity > 45")
    spells = li.select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("start"), F.when(F.col("l_linenumber") % 3 > 0, F.year("l_shipdate") + F.col("l_linenumber")).alias("end"))
    return polygons.rasterize_panel(_areas(spark, d), spells, 1.0, (1994, 1998)).select("row", "col", "year", "n")


@query(
    """WITH p AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, [0.001, 0.25, 0.5, 0.75, 0.999]) AS p FROM customer GROUP BY 1)
    SELECT c_custkey AS k, (v < p[1] OR v > p[5]) AS beyond_quantile, (v < p[3] - 0.8 * (p[4] - p[2]) OR v > p[3] + 0.8 * (p[4] - p[2])) AS beyond_iqr FROM (SELECT c_custkey, c_nationkey AS g, c_acctbal AS v FROM customer) JOIN p USING (g)"""
)
def q_outlier_tails(spark, d):
    """Beyond the outer thousandths, or far from the median."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    return stats.outlier_flags(c, ["g"], "v", q=0.001, iqr=0.8).select("k", "beyond_quantile", "beyond_iqr")


@query(
    f"""WITH {_AREAS}, tiles AS (SELECT a.range AS ix, b.range AS iy, c.range AS year FROM range(10) a, range(15) b, range(5) c),
    met AS (SELECT ix, iy, year, id FROM tiles JOIN edges e USING (year) WHERE {_through('7.0 * iy', '7.0 * iy + 7', '7.0 * ix', '7.0 * ix + 7')}),
    held AS (SELECT ix, iy, year, id FROM tiles JOIN edges e USING (year) GROUP BY ALL
      HAVING sum(CASE WHEN (ay > 7.0 * ix) <> (by_ > 7.0 * ix) AND 7.0 * iy < (bx - ax) * (7.0 * ix - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1)
    FROM met UNION FROM held"""
)
def q_tile_features(spark, d):
    """The suppliers' areas of a year that each tile of 7 x 7 meets."""
    years = spark.range(5).select(F.col("id").alias("year"))
    tiles = grid.GridSpec(0, 0, 1, 1, 70, 105, tile=7).tiles(spark).crossJoin(F.broadcast(years))
    met = polygons.intersecting(polygons.tile_polygons(tiles, 7.0, ["year"]), _areas(spark, d), 5.0, on=["year"])
    # A supplier has one year, so that the pair tells it.
    return met.join(_areas(spark, d).select(F.col("id").alias("right_id"), "year"), "right_id").select(F.col("left_id.ix").cast("long").alias("ix"), F.col("left_id.iy").cast("long").alias("iy"), "year", F.col("right_id").alias("id"))


@query(
    """WITH RECURSIVE p AS (SELECT s_suppkey AS k, (s_suppkey * 53 % 997)::DOUBLE AS x, (s_suppkey * 29 % 641)::DOUBLE AS y FROM supplier),
    e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT a AS k, min(b) AS cluster FROM r GROUP BY a"""
)
def q_dbscan(spark, d):
    s = F.col("s_suppkey")
    pts = _t(spark, d, "supplier").select(s.alias("k"), (s * 53 % 997).cast("double").alias("x"), (s * 29 % 641).cast("double").alias("y"))
    return spatial.clusters(pts, "k", "x", "y", 40.0)


@query(
    """WITH RECURSIVE p AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 997)::DOUBLE AS x, (o_orderkey * 91 % 1009)::DOUBLE AS y, o_orderpriority AS kind FROM orders WHERE o_orderkey % 10 < 3 OR o_orderkey * 37 % 997 < 40),
    e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 9 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 81),
    c AS (SELECT a AS k FROM e GROUP BY a HAVING count(*) >= 4), l AS (SELECT a, b FROM e WHERE a IN (FROM c) AND b IN (FROM c)),
    r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b WHERE l.b > r.a),
    m AS (SELECT b AS k, min(a) AS cluster FROM r GROUP BY b),
    z AS (SELECT k, cluster, 'core' AS kind FROM m UNION ALL SELECT p.k, min(m.cluster), CASE WHEN min(m.cluster) IS NULL THEN 'noise' ELSE 'border' END FROM p LEFT JOIN e ON e.a = p.k LEFT JOIN m ON m.k = e.b WHERE p.k NOT IN (FROM c) GROUP BY p.k)
    SELECT k, cluster, kind FROM z"""
)
def q_density_clusters(spark, d):
    """Core, border and noise points; a strip of the plane is dense."""
    k = F.col("o_orderkey")
    pts = _t(spark, d, "orders").filter((k % 10 < 3) | (k * 37 % 997 < 40)).select(k.alias("k"), (k * 37 % 997).cast("double").alias("x"), (k * 91 % 1009).cast("double").alias("y"))
    return density.density_clusters(pts, "k", "x", "y", 9.0, min_samples=4).select("k", "cluster", "kind")


@query(
    """WITH RECURSIVE p AS (SELECT s_suppkey AS k, (s_suppkey * 53 % 997)::DOUBLE AS x, (s_suppkey * 29 % 641)::DOUBLE AS y, s_nationkey % 3 AS kind FROM supplier),
    e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS k, min(b) AS cluster FROM r GROUP BY a)
    SELECT cluster, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, count(*) AS n, count_if(kind = 0)::BIGINT AS n_0, count_if(kind = 1)::BIGINT AS n_1, count_if(kind = 2)::BIGINT AS n_2 FROM p JOIN c USING (k) GROUP BY cluster"""
)
def q_cluster_summary(spark, d):
    """Clusters of suppliers with their centroids and how many of each kind they have."""
    s = F.col("s_suppkey")
    pts = _t(spark, d, "supplier").select(s.alias("k"), (s * 53 % 997).cast("double").alias("x"), (s * 29 % 641).cast("double").alias("y"), (F.col("s_nationkey") % 3).cast("string").alias("kind"))
    joined = pts.join(spatial.clusters(pts, "k", "x", "y", 40.0), "k")
    return density.cluster_summary(joined, "x", "y", "kind", ["0", "1", "2"]).select("cluster", _r("cx"), _r("cy"), "n", "n_0", "n_1", "n_2")


@query(
    """WITH RECURSIVE o AS (SELECT o_orderpriority AS g, o_orderkey AS k, floor(o_totalprice)::BIGINT AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders),
    r AS (SELECT g, k, i, s AS used, 1 AS n, 0 AS batch FROM o WHERE i = 1 UNION ALL
      SELECT o.g, o.k, o.i, CASE WHEN r.used + o.s > 1500000 OR r.n >= 12 THEN o.s ELSE r.used + o.s END, CASE WHEN r.used + o.s > 1500000 OR r.n >= 12 THEN 1 ELSE r.n + 1 END,
        r.batch + CASE WHEN r.used + o.s > 1500000 OR r.n >= 12 THEN 1 ELSE 0 END FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
    SELECT g, k, batch::INTEGER AS batch FROM r"""
)
def q_greedy_batches(spark, d):
    """Orders of a priority in batches of 12, or of 1.5 million in value."""
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("s"))
    return catalog.batches(o, "k", "s", 1_500_000, 12, "g").select("g", "k", "batch")


# --- regression ---------------------------------------------------------------


@query(
    """WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
    SELECT round(a, 3) AS intercept, round(b, 4) AS slope, n::DOUBLE AS n, round(r2, 6) AS r2, round(sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS se FROM r"""
)
def q_ols(spark, d):
    f = regression.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    row = (float(f.coef[0]), float(f.coef[1]), f.n, float(f.stats["r2"]), float(f.se[1]))
    out = spark.createDataFrame([row], "intercept double, slope double, n double, r2 double, se double")
    return out.select(_r("intercept", 3), _r("slope"), "n", _r("r2", 6), _r("se", 5))


@query(
    """WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz FROM lineitem)
    SELECT name, round(CASE name WHEN 'l_quantity' THEN (xy * zz - zy * xz) ELSE (zy * xx - xy * xz) END / (xx * zz - xz * xz), 3) AS estimate FROM s, (VALUES ('l_quantity'), ('l_discount')) v(name)"""
)
def q_ols_multi(spark, d):
    f = regression.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return regression.fit_frame(spark, f).filter("name != 'Intercept'").select("name", _r("estimate", 3))


@query(
    """SELECT l_quantity, l_discount, count(*) AS n, round(sum(l_extendedprice), 2) AS sum_y FROM lineitem GROUP BY ALL"""
)
def q_compress(spark, d):
    return regression.compress(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("l_quantity", "l_discount", "n", _r("sum_y", 2))


_CLUSTERED = """WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_suppkey AS g1, l_linenumber AS g2 FROM lineitem),
    s AS (SELECT avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, count(*)::DOUBLE AS n FROM d),
    u AS (SELECT g1, g2, (x - mx) * (y - a - b * x) AS u FROM d, s)"""


@query(
    f"""{_CLUSTERED}, c AS (SELECT sum(t * t) AS m, count(*)::DOUBLE AS g FROM (SELECT g1, sum(u) AS t FROM u GROUP BY g1))
    SELECT round(b, 4) AS slope, round(sqrt(m * g / (g - 1) * (n - 1) / (n - 2)) / sxx, 5) AS se FROM c, s"""
)
def q_crv1(spark, d):
    f = regression.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], cluster=["l_suppkey"])
    return spark.createDataFrame([(float(f.coef[1]), float(f.se[1]))], "slope double, se double").select(_r("slope"), _r("se", 5))


_PART = "SELECT sum(t * t) * (count(*) / (count(*) - 1.0)) AS m FROM (SELECT sum(u) AS t FROM u GROUP BY {0})"


@query(f"{_CLUSTERED}, a AS ({_PART.format('g1')}), b2 AS ({_PART.format('g2')}), ab AS ({_PART.format('g1, g2')}) SELECT round(b, 4) AS slope, round(sqrt((a.m + b2.m - ab.m) * (n - 1) / (n - 2)) / sxx, 5) AS se FROM a, b2, ab, s")
def q_twoway_cluster(spark, d):
    f = regression.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], cluster=["l_suppkey", "l_linenumber"])
    return spark.createDataFrame([(float(f.coef[1]), float(f.se[1]))], "slope double, se double").select(_r("slope"), _r("se", 5))


@query(
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_quantity + 10 * l_linenumber AS z FROM lineitem), s AS (SELECT covar_pop(z, y) AS zy, covar_pop(z, x) AS zx, regr_r2(x, z) AS r2, count(*) AS n FROM d)
    SELECT round(zy / zx, 4) AS slope, round(r2 / (1 - r2) * (n - 2), 2) AS first_f FROM s"""
)
def q_2sls(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + 10 * F.col("l_linenumber")).alias("z"))
    f = regression.tsls(li, "y", [], ["x"], ["z"])
    return spark.createDataFrame([(float(f.coef[1]), f.first_stage["x"].stats["f"])], "slope double, first_f double").select(_r("slope"), _r("first_f", 2))


_HC1 = "SELECT l_extendedprice AS y, l_quantity AS x, {w}::DOUBLE AS w FROM lineitem"
_HC1 += "), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w) AS n FROM d), c AS (SELECT x - mx AS x, y - my AS y, w, n FROM d, m), b AS (SELECT sum(w * x * y) / sum(w * x * x) AS b, sum(w * x * x) AS sxx FROM c)"
_HC1 += " SELECT round(any_value(b), 4) AS slope, round(sqrt(any_value(n) / (any_value(n) - 2) * sum(w * w * x * x * (y - b * x) ** 2)) / any_value(sxx), 5) AS se FROM c, b"


def _hc1(spark, d, weight):
    li = _t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), weight.cast("double").alias("w"))
    f = regression.ols(li, "y", ["x"], se="HC1", weight="w")
    return spark.createDataFrame([(float(f.coef[1]), float(f.se[1]))], "slope double, se double").select(_r("slope"), _r("se", 5))


@query("WITH d AS (" + _HC1.format(w="1"))
def q_hc1(spark, d):
    return _hc1(spark, d, F.lit(1))


@query("WITH d AS (" + _HC1.format(w="l_linenumber"))
def q_hc1_weighted(spark, d):
    return _hc1(spark, d, F.col("l_linenumber"))


@query(
    """WITH d AS (SELECT l_extendedprice AS y, l_quantity::DOUBLE AS x, (l_quantity + 10 * l_linenumber)::DOUBLE AS z, l_suppkey AS g FROM lineitem),
    c AS (SELECT y - avg(y) OVER w AS y, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z, g FROM d WINDOW w AS (PARTITION BY g)),
    b AS (SELECT sum(z * y) / sum(z * x) AS b, sum(z * x) AS zx, sum(z * z) AS zz, count(*) - 1 - count(DISTINCT g) AS df FROM c)
    SELECT round(any_value(b), 4) AS slope, round(sqrt(sum((y - b * x) ** 2) / any_value(df) * any_value(zz)) / any_value(zx), 5) AS se, any_value(df)::DOUBLE AS df FROM c, b"""
)
def q_iv_effects(spark, d):
    from panelspark.plans import formula

    li = _t(spark, d, "lineitem").withColumn("z", F.col("l_quantity") + 10 * F.col("l_linenumber"))
    f = formula.fit(li, "l_extendedprice ~ 0 | l_suppkey | l_quantity ~ z")
    return spark.createDataFrame([(float(f.coef[0]), float(f.se[0]), float(f.df))], "slope double, se double, df double").select(_r("slope"), _r("se", 5), "df")


@query(
    f"""WITH a AS (SELECT unit, year, x FROM ({_PANEL}) QUALIFY count(*) OVER (PARTITION BY unit) > 1)
    SELECT unit, year, x FROM a QUALIFY count(*) OVER (PARTITION BY year) > 1"""
)
def q_singletons(spark, d):
    return regression.prune_singletons(_panel(spark, d), ["unit", "year"], iterative=False).select("unit", "year", "x")


def _pruned(rounds: int) -> str:
    """CTEs a0, b1, a1, ...: rows without lone units, then without lone years, again and again; past the fixed point nothing changes."""
    parts = [f"a0 AS ({_PANEL})"]
    for i in range(rounds):
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT unit, year, x, y FROM a{i} QUALIFY count(*) OVER (PARTITION BY unit) > 1)")
        parts.append(f"a{i + 1} AS MATERIALIZED (SELECT unit, year, x, y FROM b{i + 1} QUALIFY count(*) OVER (PARTITION BY year) > 1)")
    return ", ".join(parts)


@query(f"WITH {_pruned(8)} SELECT unit, year, x FROM a8")
def q_singletons_iterative(spark, d):
    """The fixed point of what `q_singletons` does once."""
    return regression.prune_singletons(_panel(spark, d), ["unit", "year"]).select("unit", "year", "x")


_DENSE = """p AS (SELECT n_nationkey AS unit, year(o_orderdate)::INTEGER AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000 AS y, count(*)::DOUBLE AS x FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    b AS (SELECT * FROM p WHERE unit IN (SELECT unit FROM p GROUP BY unit HAVING count(*) = (SELECT count(DISTINCT year) FROM p)))"""


def _dense(spark, d):
    p = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = p.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000).alias("y"), F.count(F.lit(1)).cast("double").alias("x"))
    n = p.agg(F.count_distinct("year").alias("n"))
    full = p.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).filter("k = n").select("unit")
    return p.join(full, "unit")


@query(
    f"""WITH {_DENSE}, t AS (SELECT y - avg(y) OVER u - avg(y) OVER v + avg(y) OVER () AS y, x - avg(x) OVER u - avg(x) OVER v + avg(x) OVER () AS x FROM b WINDOW u AS (PARTITION BY unit), v AS (PARTITION BY year))
    SELECT count(*)::DOUBLE AS n, round(sum(x * y) / sum(x * x), 4) AS slope FROM t"""
)
def q_twfe_balanced(spark, d):
    f = regression.fe_ols(_dense(spark, d), "y", ["x"], ["unit", "year"])
    return spark.createDataFrame([(f.n, float(f.coef[0]))], "n double, slope double").select("n", _r("slope"))


def _swept(rounds: int, source: str = _PANEL) -> str:
    """CTEs f (unit, year, y, x less their unit and year effects): each round gives the years what the units leave, and starts anew from there."""
    parts = [f"p AS MATERIALIZED (SELECT unit, year, y::DOUBLE AS y, x::DOUBLE AS x FROM ({source}))", "t0 AS (SELECT DISTINCT year, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tx FROM p)"]
    for i in range(rounds):
        parts.append(f"u{i} AS MATERIALIZED (SELECT unit, avg(y - ty) AS uy, avg(x - tx) AS ux FROM p JOIN t{i} USING (year) GROUP BY unit)")
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT year, avg(y - uy) AS ty, avg(x - ux) AS tx FROM p JOIN u{i} USING (unit) GROUP BY year)")
    k = rounds - 1
    return ", ".join([*parts, f"f AS MATERIALIZED (SELECT unit, year, y - uy - ty AS y, x - ux - tx AS x FROM p JOIN u{k} USING (unit) JOIN t{rounds} USING (year))"])


_SLOPE = "SELECT sum(x * y) / sum(x * x) AS b FROM f"


@query(
    f"""WITH {_swept(40)}, s AS ({_SLOPE}), g AS (SELECT sum(x * (y - b * x)) AS c FROM f, s GROUP BY unit),
    n AS (SELECT count(*) AS n, count(DISTINCT unit) + count(DISTINCT year) - 1 AS a FROM f)
    SELECT 'x' AS name, round(b, 2) AS estimate, round(sqrt((SELECT sum(c * c) * count(*) / (count(*) - 1) FROM g) * (n - 1) / (n - 1 - a)) / (SELECT sum(x * x) FROM f), 2) AS std_error FROM s, n"""
)
def q_fe_iter(spark, d):
    f = regression.fe_ols(_panel(spark, d), "y", ["x"], ["unit", "year"], cluster=["unit"])
    return regression.fit_frame(spark, f).select("name", _r("estimate", 2), _r("std_error", 2))


@query(f"WITH {_swept(40)} SELECT unit, year, round(y, 3) + 0.0 AS y, round(x, 6) + 0.0 AS x FROM f")
def q_demean_unbalanced(spark, d):
    """Unit and year effects out of every row of an unbalanced panel."""
    out = absorb.demean(_panel(spark, d), ["unit", "year"], ["y", "x"])
    return out.select("unit", "year", (F.round("y", 3) + 0.0).alias("y"), (F.round("x", 6) + 0.0).alias("x"))


@query(
    f"""WITH m AS (SELECT unit, year, y, x::DOUBLE AS x, avg(x) OVER (PARTITION BY unit) AS z FROM ({_PANEL})),
    w AS (SELECT y - avg(y) OVER t AS y, x - avg(x) OVER t AS x, z - avg(z) OVER t AS z FROM m WINDOW t AS (PARTITION BY year)),
    s AS (SELECT sum(x * y) AS xy, sum(z * y) AS zy, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(y * y) AS yy FROM w),
    b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s),
    n AS (SELECT count(*) - 2 - count(DISTINCT year) AS df FROM m)
    SELECT df::DOUBLE AS df, round(bx, 2) AS slope, round(sqrt((yy - bx * xy - bz * zy) / df * zz / (xx * zz - xz * xz)), 2) AS std_error FROM b, n"""
)
def q_auto_effects(spark, d):
    """Means of x by unit, the effect with most groups, beside x; years taken out."""
    f = regression.fe_ols(_panel(spark, d), "y", ["x"], ["year", "unit"], method="auto")
    return spark.createDataFrame([(float(f.df), float(f.coef[0]), float(f.se[0]))], "df double, slope double, std_error double").select("df", _r("slope", 2), _r("std_error", 2))


@query(f"""WITH p AS ({_PANEL}), m AS (SELECT y, x::DOUBLE AS x, avg(x) OVER (PARTITION BY unit) AS z FROM p),
    s AS (SELECT covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz FROM m) SELECT round((xy * zz - zy * xz) / (xx * zz - xz * xz), 2) AS slope FROM s""")
def q_mundlak_ols(spark, d):
    f = regression.fe_ols(_panel(spark, d), "y", ["x"], ["unit"], method="mundlak")
    return spark.createDataFrame([(float(f.coef[1]),)], "slope double").select(_r("slope", 2))


@query("SELECT round(regr_slope(y, ln(x + 1)), 4) AS slope FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem WHERE year(l_shipdate) >= 1996 AND year(l_shipdate) <= 1999)")
def q_formula(spark, d):
    from panelspark.plans import formula, specs

    li = _t(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    f = formula.fit(li, "l_extendedprice ~ log(l_quantity + 1)", specs.conjunction(specs.temporal_where("1996-1999")))
    return spark.createDataFrame([(float(f.coef[1]),)], "slope double").select(_r("slope"))


@query(
    """SELECT year, r // 4 * 16 + c // 4 AS cell, round(avg(CASE WHEN q > 40 THEN 40.0 ELSE q END), 4) AS lights_q, any_value(n.v) AS static_v FROM
    (SELECT (l_orderkey % 64) AS r, (l_partkey % 64) AS c, year(l_shipdate)::SMALLINT AS year, l_quantity AS q FROM lineitem) l
    LEFT JOIN (SELECT k AS cell, (k % 7)::DOUBLE AS v FROM range(256) t(k)) n ON n.cell = r // 4 * 16 + c // 4 GROUP BY ALL"""
)
def q_assemble(spark, d):
    from panelspark.plans.assemble import Assembly, Source, assemble

    li = _t(spark, d, "lineitem")
    lights = li.select((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"), F.year("l_shipdate").cast("smallint").alias("year"), F.least(F.col("l_quantity"), F.lit(40.0)).alias("q"))
    static = spark.range(256).select((F.col("id") / 16).cast("long").alias("row"), (F.col("id") % 16).alias("col"), (F.col("id") % 7).cast("double").alias("v"))
    plan = Assembly(grid.GridSpec(0, 0, 1, 1, 16, 16, tile=16), [Source("lights", lights, ["q"], factor=4, resampling="average"), Source("static", static, ["v"])])
    out = assemble(plan).filter("year is not null")
    return out.select("year", F.col("pixel_id").alias("cell"), _r("lights_q"), "static_v")


# --- labels, grids, candidates ------------------------------------------------


@query("SELECT c_custkey AS k, (dense_rank() OVER (ORDER BY f, c_mktsegment) - 1)::INTEGER AS code FROM customer JOIN (SELECT c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1) USING (c_mktsegment)")
def q_factorize(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("l"))
    return panel.factorize(c, "l", "k").select("k", "code")


@query("SELECT c_custkey AS k, n_regionkey AS id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 > 0")
def q_two_hop(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"))
    n = _t(spark, d, "nation").filter("n_nationkey % 5 > 0")
    first = n.select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("code"))
    second = n.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("id"))
    return panel.two_hop(c, "name", first, second)[0].select("k", "id")


@query("SELECT r.i AS row, c.i AS col, coalesce(n, 0) AS n FROM range(0, 20) r(i), range(3, 15) c(i) LEFT JOIN (SELECT l_suppkey % 20 AS row, l_linenumber AS col, count(*) AS n FROM lineitem GROUP BY ALL) x ON x.row = r.i AND x.col = c.i")
def q_dense_grid(spark, d):
    li = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return panel.dense(li, {"row": (0, 19), "col": (3, 14)}, ["n"], 0)


@query("SELECT n_nationkey AS k, coalesce(bool_or(c_mktsegment = 'BUILDING'), false) AS \"BUILDING\", coalesce(bool_or(c_mktsegment = 'MACHINERY'), false) AS \"MACHINERY\" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def q_wide_flags(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment")
    return panel.wide_flags(c, "k", "c_mktsegment", ["BUILDING", "MACHINERY"], _t(spark, d, "nation").select(F.col("n_nationkey").alias("k")))


@query(f"SELECT year, count(*) AS n_files, min(doy) AS first_day, max(doy) AS last_day FROM {_CATALOG} GROUP BY year")
def q_group_files(spark, d):
    g = panel.grouped_files(_catalog(spark, d), ["year"], "relative_path")
    day = lambda c: F.substring(F.regexp_extract(c, r"A(\d{7})", 1), 5, 3).cast("int")
    return g.select("year", "n_files", day(F.element_at("files", 1)).alias("first_day"), day(F.element_at("files", -1)).alias("last_day"))


@query(
    """SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN 'year_and_truth' WHEN p_size % 3 = 0 THEN 'year' WHEN p_size % 5 = 0 THEN 'truth' END AS reason FROM part"""
)
def q_candidates(spark, d):
    t = F.when(F.col("p_size") % 4 == 0, " NA ").when(F.col("p_size") % 3 == 0, F.concat(F.lit("opened in 19"), (F.col("p_size") + 40).cast("string"))).otherwise("no date")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), text.candidate_reason(t, F.col("p_size") % 5 == 0).alias("reason"))


@query(
    """WITH a AS (SELECT l_suppkey % 30 AS i, l_partkey % 30 AS j, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY ALL), b AS (SELECT o_custkey % 40 AS i, o_orderkey % 40 AS j, count(*) AS n FROM orders GROUP BY ALL)
    SELECT i AS row, j AS col, q, n FROM a JOIN b USING (i, j)"""
)
def q_align_grids(spark, d):
    a = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("i"), (F.col("l_partkey") % 30).alias("j")).agg(F.round(F.avg("l_quantity"), 4).alias("q"))
    b = _t(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 40).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    place = lambda t, c: t.select((F.col("i") * 0.05 + 0.001).alias("lat"), (F.col("j") * 0.05 - 0.001).alias("lon"), c)
    return panel.align(place(a, "q"), place(b, "n"), "lat", "lon", 0.05).select("row", "col", "q", "n")


@query(
    """SELECT avg((v IS NULL)::INT)::DOUBLE AS v_null_share, avg((v = 0)::INT)::DOUBLE AS v_zero_share FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS v FROM lineitem)"""
)
def q_missing_shares(spark, d):
    li = _t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("v"))
    return stats.missing_shares(li, ["v"])


import panelspark.queries_more  # noqa: E402, F401
