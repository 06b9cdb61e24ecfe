"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others run."""

import math

import duckdb
import pytest

from lodeframe.plans import library

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v) if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in library.ORACLES:
        assert columns
        return
    answer = duck.execute(library.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    assert found == sorted(([plain(dict(zip(names, row, strict=True))[c]) for c in columns] for row in answer.fetchall()), key=repr)
