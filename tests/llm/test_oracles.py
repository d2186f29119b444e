"""The registered queries that have an oracle, against DuckDB."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from lorequarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_its_oracle(spark, sf_dir, name):
    names, want = rows_of_sql(connect(sf_dir), queries.oracle_sql()[name])
    frame = queries.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == names and rows_of(frame) == want
