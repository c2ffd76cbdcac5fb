"""Every registered retrieval query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value if value is None or isinstance(value, (bool, int)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(repr([plain(v) for v in row]) for row in got.select(*columns).collect())
    if name not in registry.oracle_sql():
        assert mine
        return
    found = duck.execute(registry.oracle_sql()[name])
    at = {c[0]: k for k, c in enumerate(found.description)}
    assert sorted(at) == columns
    assert mine == sorted(repr([plain(row[at[c]]) for c in columns]) for row in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
