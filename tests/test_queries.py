import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = {k: q for k, q in entry.queries().items() if k.startswith("q_")}


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for name in os.listdir(SF):
        out.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return out


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_its_sql(spark, db, name):
    got = OWN[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((plain(tuple(r)) for r in got.select(columns).collect()), key=repr)
    if name in entry.oracle_sql():
        want = db.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        picked = want.select(*[f'"{c}"' for c in columns]).fetchall()
        assert rows == sorted((plain(r) for r in picked), key=repr)
    else:
        assert rows


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
