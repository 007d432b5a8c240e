"""More named queries: files and results, texts and dates, terms and filters. `queries` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import text, values
from panelspark.operators import catalog, panel, regression, spatial
from panelspark.plans import specs
from panelspark.queries import _r, _t, query

# --- files and results ----------------------------------------------------------

_FILES = "(SELECT o_orderstatus AS g, year(o_orderdate)::INTEGER AS year, 'out/' || o_orderkey || '.' || CASE o_orderkey % 4 WHEN 0 THEN 'nc' WHEN 1 THEN 'HDF' WHEN 2 THEN 'tif' ELSE 'csv' END AS relative_path, lower(CASE o_orderkey % 4 WHEN 0 THEN 'nc' WHEN 1 THEN 'hdf' WHEN 2 THEN 'tif' ELSE 'csv' END) AS ext FROM orders WHERE o_orderkey % 4 > 0 OR o_custkey % 3 = 0)"


def _files(spark, d):
    k = F.col("o_orderkey")
    ext = F.when(k % 4 == 0, "nc").when(k % 4 == 1, "HDF").when(k % 4 == 2, "tif").otherwise("csv")
    o = _t(spark, d, "orders").filter((k % 4 > 0) | (F.col("o_custkey") % 3 == 0))
    return o.select(F.col("o_orderstatus").alias("g"), F.year("o_orderdate").alias("year"), F.concat(F.lit("out/"), k.cast("string"), F.lit("."), ext).alias("relative_path"), ext.alias("ext"))


@query(f"SELECT g, year, relative_path FROM {_FILES} QUALIFY row_number() OVER (PARTITION BY g, year ORDER BY CASE ext WHEN 'nc' THEN 1 WHEN 'tif' THEN 2 WHEN 'hdf' THEN 3 ELSE 4 END, relative_path) = 1")
def q_preferred_files(spark, d):
    """One file a year and status, by extension and then by name."""
    return catalog.preferred(_files(spark, d), ["g", "year"], "ext", ["nc", "tif", "hdf"]).select("g", "year", "relative_path")


@query("SELECT l_orderkey % 64 AS r, l_partkey % 64 AS c, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY 1, 2")
def q_mosaic(spark, d):
    """Overlapping swaths of cells: the last value of each cell that has one.

    An order and line number can stand at several rows. Of those the first in the table counts
    (by file, then place in it), as in the SQL where one thread reads.
    """
    v = F.col("l_extendedprice")
    o = F.when(v.isNotNull(), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("r"), (F.col("l_partkey") % 64).alias("c"), F.when(o.isNotNull(), v).alias("v"), o.alias("o"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spatial.spread_cells(li, ["r", "c"], "o", ("file", "row")).select("r", "c", "v")


@query("SELECT o_custkey AS k, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey) AS result FROM orders GROUP BY 1")
def q_newest_results(spark, d):
    """The newest result of each customer, by stamps that sort as text."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("result"), F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey").cast("string")).alias("stamp"))
    return specs.newest_results(o, ["k"], "stamp").select("k", "result")


@query("SELECT c_name AS model_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000)")
def q_missing_models(spark, d):
    """Customers without a large order, as models without a result."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("model_name"))
    done = _t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key")).join(c, "key")
    return specs.missing_models(c.select("model_name"), done)


@query(
    """WITH m AS (SELECT c_mktsegment AS table_name, o_orderpriority AS dataset, o_orderstatus AS method FROM orders JOIN customer ON c_custkey = o_custkey),
    l AS (SELECT o_orderpriority AS dataset, o_orderstatus AS method, (max(o_orderkey) % 97)::DOUBLE AS seconds FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT table_name, sum(coalesce(seconds, 60.0)) AS seconds, count(*) AS n_models FROM m LEFT JOIN l USING (dataset, method) GROUP BY 1"""
)
def q_table_runtimes(spark, d):
    """Seconds of each table's models, from known runtimes or a fallback."""
    o = _t(spark, d, "orders")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("table_name"))
    models = o.join(c, "o_custkey").select("table_name", F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method"))
    limits = o.filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method")).agg((F.max("o_orderkey") % 97).cast("double").alias("seconds"))
    return specs.runtimes(models, limits, 60.0)


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, NULL FROM orders, range(2) WHERE o_orderkey % 3 = 0")
def q_append_new(spark, d):
    """Rows whose key is not there yet come in, those of the batch as often as they stand in it."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    batch = o.select("k").union(o.select("k"))
    return panel.new_rows(o.filter("k % 3 > 0"), batch, "k")


@query("SELECT 'd/' || o_custkey % 40 AS directory, count(*) AS n_files FROM orders WHERE o_orderkey % 4 = 2 GROUP BY 1 HAVING count(*) >= 80")
def q_full_directories(spark, d):
    """Directories with eighty files of a kind or more."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(F.concat(F.lit("d/"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 4 == 2, ".HDF").otherwise(".nc")).alias("path"))
    return catalog.full_directories(o, "path", 80, ".hdf")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer ORDER BY coalesce(c_nationkey = 7, false) DESC, c_custkey LIMIT 1")
def q_preferred_row(spark, d):
    """The first customer of a wanted nation, or else the first."""
    c = _t(spark, d, "customer")
    return catalog.pick(c, "c_nationkey", 7, "c_custkey").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


# --- texts and dates --------------------------------------------------------------


@query(
    r"""SELECT doc_id, ceil(length(text) / 4)::BIGINT + 8 AS tokens, regexp_matches(text, '\b(18|19|20)\d{2}\b') AS has_year, nullif(regexp_extract(text, '(\d{4})', 1), '')::INTEGER AS first_year,
    list_filter(list_transform(regexp_extract_all(text, '(\d{4})', 1), lambda x: x::INTEGER), lambda y: y BETWEEN 1992 AND 2030)[1] AS year FROM documents"""
)
def q_text_years(spark, d):
    """What whole texts say about years, and about how many tokens they have."""
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.token_estimate(t, 8).alias("tokens"), text.has_year(t).alias("has_year"), text.first_year(t).alias("first_year"), text.bounded_year(t, 1992, 2030).alias("year"))


_RULES = [("/fr/", "french"), ("Page=", "paged"), (".example.com", "example")]


@query(
    """SELECT page_id, CASE WHEN contains(lower(url), '/fr/') THEN 'french' WHEN contains(lower(url), 'page=') THEN 'paged' WHEN contains(lower(url), '.example.com') THEN 'example' ELSE 'unknown' END AS kind,
    regexp_replace('me@host:' || url, '^[^/@:]+@[^/@:]+:', '') AS path, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?]+)', 1), '(\\.com|\\.org)$', '') AS bare, regexp_replace(url, '([&%$#_{}])', '\\\\\\1', 'g') AS latex FROM pages"""
)
def q_page_labels(spark, d):
    """A page's kind by rules, its path without a host before it, its site without its ending, and its url for a table."""
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", text.source_type(u, _RULES).alias("kind"), text.strip_host(F.concat(F.lit("me@host:"), u)).alias("path"), text.without_suffix(text.extract(u, r"^[a-z]+://([^/?]+)"), [r"\.com", r"\.org"]).alias("bare"), text.latex_escape(u).alias("latex"))


@query(
    """SELECT event_id, to_json({'event_id': event_id, 'event_type': event_type, 'user_id': user_id})::VARCHAR AS row, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events"""
)
def q_json_rows(spark, d):
    """Rows as JSON with their keys in order, and the first of several JSON paths that says something."""
    e = _t(spark, d, "events")
    made = e.withColumn("row", values.sorted_json(["user_id", "event_id", "event_type"]))
    from panelspark.sources.readers import json_texts

    return json_texts(made, "props", ["$.missing", "$.k"], "k").select("event_id", "row", "k")


@query(
    """SELECT event_id, epoch_ms(round_even(epoch_us(ts) / 1000, 0)::BIGINT) AS ms, greatest(0, epoch(date_trunc('second', ts))::BIGINT - coalesce(epoch(date_trunc('second', lag(ts) OVER w))::BIGINT, 0))::BIGINT AS since
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def q_event_times(spark, d):
    """Stamps to the millisecond, and the seconds since a user's event before."""
    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    from pyspark.sql import Window

    before = F.coalesce(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.timestamp_seconds(F.lit(0)))
    return e.select("event_id", text.to_millis(F.col("ts")).cast("timestamp_ntz").alias("ms"), text.elapsed(before, F.col("ts")).alias("since"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 100 > 50 THEN 1900 + o_orderkey % 100 ELSE 2000 + o_orderkey % 100 END AS fiscal, make_date(year(o_orderdate), 12, 31) AS ends,
    (make_date(year(o_orderdate), 1, 1) + (o_orderkey % 365)::INTEGER)::DATE AS day FROM orders"""
)
def q_year_dates(spark, d):
    """Two-digit years, a year's last day, a day by its number."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    return _t(spark, d, "orders").select(k.alias("k"), text.fiscal_year(k % 100).alias("fiscal"), text.year_end(y).alias("ends"), text.day_of_year(y, (k % 365 + 1).cast("int")).alias("day"))


# --- terms and filters -------------------------------------------------------------


@query(
    """SELECT l_orderkey AS k, l_linenumber AS n, pow(l_quantity, 2) AS l_quantity_pow2, pow(l_quantity, 3) AS l_quantity_pow3, l_quantity * l_discount AS l_quantity_x_l_discount, l_quantity * l_tax AS l_quantity_x_l_tax, l_discount * l_tax AS l_discount_x_l_tax,
    round((l_extendedprice - l_quantity) / nullif(l_extendedprice + l_quantity, 0), 9) AS index_ FROM lineitem"""
)
def q_terms(spark, d):
    """Powers, products by pairs, and a normalised difference."""
    li = _t(spark, d, "lineitem")
    index = F.round(values.normalized_difference(F.col("l_extendedprice"), F.col("l_quantity")), 9)
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *values.polynomial("l_quantity", 3), *values.pairwise(["l_quantity", "l_discount", "l_tax"]), index.alias("index_"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_nationkey < 9 THEN 'near' WHEN c_mktsegment = 'BUILDING' THEN 'builder' END AS label FROM customer")
def q_last_label(spark, d):
    """Flags back to one label, the last that holds."""
    flags = {"builder": F.col("c_mktsegment") == "BUILDING", "near": F.col("c_nationkey") < 9, "rich": F.col("c_acctbal") > 5000}
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), values.undummy(flags).alias("label"))


@query(
    """SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, year(o_orderdate) AS year FROM orders) WHERE year >= 1994 AND year <= 1996 AND o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND o_custkey > 10"""
)
def q_sheet_filter(spark, d):
    """A sheet's extent, subset and query as one condition."""
    where = specs.conjunction(specs.temporal_where("1994-1996"), specs.isin_where({"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT"}), specs.without_years(specs.workbook_where("(o_custkey > 10) & (year >= 1990)")))
    return _t(spark, d, "orders").withColumn("year", F.year("o_orderdate")).filter(where).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    """SELECT count(*) AS n, count_if(present)::BIGINT AS n_present, round(sum(clipped), 2) AS total FROM (SELECT (a IS NOT NULL OR b IS NOT NULL) AS present, CASE WHEN a IS NOT NULL THEN greatest(a, b) END AS clipped
    FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE 10 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 20.0::DOUBLE END AS b FROM lineitem))"""
)
def q_presence_and_clip(spark, d):
    """Rows with any value, and values held up to a bound that may be missing."""
    n = F.col("l_linenumber")
    li = _t(spark, d, "lineitem").select(F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.col("l_quantity")).otherwise(10.0).alias("a"), F.when(n % 2 == 0, 20.0).alias("b"))
    return li.select(values.any_value_present(["a", "b"]).alias("p"), values.clip(F.col("a"), F.col("b"), F.lit(None).cast("double")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("n_present"), F.round(F.sum("c"), 2).alias("total"))


@query("SELECT count(*)::DOUBLE AS n, round((count(*) - 2) * regr_r2(l_extendedprice, l_quantity) / (1 - regr_r2(l_extendedprice, l_quantity)), 2) AS f, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def q_joint_f(spark, d):
    """The Wald F of all coefficients but the intercept."""
    f = regression.ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(float(f.n), f.joint_f(), f.stats["r2"])], "n double, f double, r2 double").select("n", _r("f", 2), _r("r2", 8))


@query(
    """WITH p AS (SELECT o_totalprice AS y, o_custkey % 17 AS x, c_nationkey AS n, year(o_orderdate) AS t FROM orders JOIN customer ON c_custkey = o_custkey),
    k AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY n, t) > 1), w AS (SELECT y - avg(y) OVER g AS y, x - avg(x) OVER g AS x FROM k WINDOW g AS (PARTITION BY n, t)),
    s AS (SELECT sum(x * y) / sum(x * x) AS b FROM w), d AS (SELECT count(*) - 1 - (SELECT count(*) FROM (SELECT DISTINCT n, t FROM k)) AS df FROM k)
    SELECT df::DOUBLE AS df, round(b, 3) AS slope, round(sqrt((SELECT sum((y - b * x) * (y - b * x)) FROM w) / df / (SELECT sum(x * x) FROM w)), 3) AS std_error FROM s, d"""
)
def q_joint_effect(spark, d):
    """An effect for each nation and year together, singletons pruned."""
    from panelspark.plans import formula

    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n"))
    o = _t(spark, d, "orders").join(c, "o_custkey").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 17).cast("double").alias("x"), "n", F.year("o_orderdate").alias("t"))
    f = formula.fit(o, "y ~ x | n^t")
    return spark.createDataFrame([(float(f.df), float(f.coef[0]), float(f.se[0]))], "df double, slope double, std_error double").select("df", _r("slope", 3), _r("std_error", 3))
