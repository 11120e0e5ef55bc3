"""Every query with SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import same_rows

from tracelode import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_diff_hunks_parses_every_order(spark):
    sf_dir = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = catalogue.queries()["diff_hunks"](spark, sf_dir).collect()
    assert sorted(r["o_orderkey"] for r in got) == sorted(r["o_orderkey"] for r in orders.select("o_orderkey").collect())
    assert all((r["path"], r["new_start"], r["new_length"], r["added"], r["removed_count"]) == (f"o/{r['o_orderkey']}.txt", 1, 3, "2,3", 1) for r in got)


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
