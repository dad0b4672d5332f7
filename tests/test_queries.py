"""Every query of the library against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import FOUND

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", [name for name, (_, sql) in FOUND.items() if sql])
def test_equals_sql(spark, duck, name):
    query, sql = FOUND[name]
    own, other = query(spark, SF).toPandas(), duck.execute(sql).df()
    columns = sorted(other.columns)
    assert sorted(own.columns) == columns
    put = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert put(own).equals(put(other))
