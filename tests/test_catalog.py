"""Every catalogue query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from recollect.plans import catalog, writes  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    con = duck.execute(catalog.SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, con.fetchall())
