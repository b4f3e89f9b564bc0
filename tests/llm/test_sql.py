"""Queries against their SQL, on whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from payspark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    own, other = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    value = lambda v: (0, "") if pd.isna(v) else (1, v)  # noqa: E731 - nulls of either side alike, and sortable
    rows = lambda frame: sorted(tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False))
    assert rows(own) == rows(other)
