"""Every registered knowledge-base query against DuckDB on the same tables."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from lorequarry.plans import layers
from lorequarry.plans import queries as Q

QUERIES, ORACLES = Q.queries() | layers.queries(), Q.ORACLES | layers.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_oracle(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    names, want = rows_of_sql(connect(sf_dir), ORACLES[name])
    assert sorted(frame.columns) == names
    assert rows_of(frame) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_driver_contract(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"query_id", "page_id", "rank"} <= set(Q.retrieve_topk(spark, sf_dir).columns)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from lorequarry.operators import index, retrieve

    plan = index.postings(retrieve.profiled(Q._pages(spark, sf_dir), "src1"))._jdf.queryExecution().toString()
    scan = next(x for x in reversed(plan.split("\n")) if "FileScan parquet" in x)
    assert "EqualTo(source,src1)" in scan and "n_chars" not in scan.split("ReadSchema")[1]
