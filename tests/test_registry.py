"""Every registered query runs on the smallest tables, and its SQL gives the same rows."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tamarack.plans import registry

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in entry.oracle_sql():
        c = duckdb.connect()
        for f in glob.glob(f"{D}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = c.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert plain(map(tuple, got)) == plain(want)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
