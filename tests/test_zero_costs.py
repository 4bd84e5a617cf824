import duckdb
import pytest
from test_catalogue import cell

from tallyloom.plans import catalogue

NAMES = ["conformal_quantiles", "exact_repeat_median", "forecast_coverage", "interval_metrics", "nested_conformal_bands", "priors_by_archetype_group", "project_history_blend", "project_history_prior"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events whose early and late costs are nothing now and then."""
    out = str(tmp_path_factory.mktemp("zeros"))
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 97 = 5 THEN 0 ELSE value END AS value, user_id % 3 AS user_id, '{{\"k\": ' || event_id % 4 || '}}' AS props) FROM '/root/testdata/sf0.001/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_costs_of_nothing_are_what_the_sql_makes_of_them(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = duck.execute(catalogue.ORACLE_SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in want)
