import os

import duckdb
import pytest

from tallyloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_the_sql(spark, name):
    c = duckdb.connect()
    for t in sorted(x.removesuffix(".parquet") for x in os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))
