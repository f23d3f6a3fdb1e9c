"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from rigspark.plans import bag_queries, catalogue, frame_queries, lens_queries, log_queries, rig_queries, scan_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect())
    order = [columns.index(c) for c in sorted(columns)]
    right = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right
