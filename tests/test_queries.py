"""Every query with SQL gives what the SQL gives."""

import duckdb
import pytest

from oracle import check
from panelspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_fixed_effects_run(spark, sf):
    row = QUERIES["q_fe_iter"](spark, sf).first()
    assert row["name"] == "x" and row["std_error"] > 0


def test_buffer_counts_of_all_orders(spark, sf):
    k = sorted(r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
    sites = [(float(s * 53 % 100), float(s * 29 % 62)) for (s,) in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    want = {i: sum((i * 37 % 997 / 10 + 0.013 - x) ** 2 + (i * 91 % 613 / 10 + 0.017 - y) ** 2 <= 25 for x, y in sites) for i in k}
    assert {r.k: r.n_sites for r in QUERIES["q_buffer_count_all"](spark, sf).collect()} == want


def test_flags_of_all_customers(spark, sf):
    seen = {tuple(r) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey", "c_mktsegment").collect()}
    got = {(r.k, r.BUILDING, r.MACHINERY) for r in QUERIES["q_wide_flags_all"](spark, sf).collect()}
    assert len(got) == 25 and got == {(k, (k, "BUILDING") in seen, (k, "MACHINERY") in seen) for k, _, _ in got}


def test_mosaic_takes_the_first_of_tied_rows(spark, tmp_path):
    """The second file is the larger one, which Spark reads first; one cell's last row has no price, and one cell has none at all."""
    d = str(tmp_path)
    (tmp_path / "lineitem.parquet").mkdir()
    parts = ["(1, 1, 1, 10.0::DOUBLE), (1, 65, 1, 11.0), (2, 2, 1, 20.0), (66, 2, 1, NULL), (3, 3, 1, NULL)", "(1, 1, 1, 12.0::DOUBLE), " + ", ".join(f"({k}, {k}, 7, {k}.0)" for k in range(70, 128))]
    for i, rows in enumerate(parts):
        duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(l_orderkey, l_partkey, l_linenumber, l_extendedprice)) TO '{d}/lineitem.parquet/part-{i}.parquet' (FORMAT parquet)")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    want = {r[:2]: r[2] for r in con.sql(ORACLES["q_mosaic"]).fetchall()}
    got = {(r.r, r.c): r.v for r in QUERIES["q_mosaic"](spark, d).collect()}
    assert got == want and (got[1, 1], got[2, 2], got[3, 3]) == (10.0, 20.0, None)
