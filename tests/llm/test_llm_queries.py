"""Every registered corpus query that SQL can express, against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from factloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings benchmark conversations pages".split():
        path = f"{SF}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}.parquet") else "")
        con.sql(f"create view {t} as select * from '{path}'")
    ours = registry.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.sql(registry.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(ours.select(*columns).collect()) == plain(theirs.select(*columns).fetchall())
