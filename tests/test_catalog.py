"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docloom import catalog

SF = os.environ.get("DOCLOOM_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = got.collect()
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(found, got.columns) == rows(want.fetchall(), want.columns)
    else:
        assert found
