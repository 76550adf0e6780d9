"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}.parquet") else "")
        c.sql(f"create view {t} as select * from '{path}'")
    return c


def plain(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(repr(tuple(fix(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.sql(registry.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    quoted = ",".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, ours.select(*columns).collect())) == plain(con.sql(f"select {quoted} from ({registry.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
