"""Every query with SQL against DuckDB, the others against plain Python, on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, data):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for _, v in sorted(zip(names, r, strict=True))) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_fixpoint(spark):
    part = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    from tidemark.plans.queries import part_edges

    to = {}
    for r in part_edges(spark, SF).collect():
        if part[r["dst"]] >= part[r["src"]] + 8:
            to.setdefault(r["src"], set()).add(r["dst"])
    proven, grown = set(), True
    while grown:
        new = {p for p in part if to.get(p, set()) <= proven}
        grown, proven = new != proven, new
    got = [r["node"] for r in QUERIES["q10_pure_fixpoint"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == proven


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
