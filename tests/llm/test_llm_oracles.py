"""Queries that SQL can express give what the SQL gives."""

import pytest

from oracle import check
from panelspark.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_every_operator_has_one_query():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names) == sorted([*QUERIES, "pipeline"])
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
