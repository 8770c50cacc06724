"""Every query with an oracle against DuckDB, names, types and rows; every other one gives rows."""

import duckdb
import pytest

from sigilframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name not in catalogue.ORACLES:
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
