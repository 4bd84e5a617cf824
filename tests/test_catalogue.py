import math
import os

import duckdb
import pytest

from tallyloom.plans import catalogue

FOLDER = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in sorted(x.removesuffix(".parquet") for x in os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows_equal_the_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name not in catalogue.ORACLE_SQL:
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert len(got) == len(want)
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)
