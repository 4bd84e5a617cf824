"""Queries that answer every row of their table, not only those of a stated set."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.retrieval import nearest_in_cells
from tallyloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def count(sql):
    return duckdb.sql(sql.format(events=f"'{FOLDER}/events.parquet'")).fetchall()[0][0]


def test_weighted_similarity_topk_answers_every_task_with_a_past(spark):
    found = catalogue.QUERIES["weighted_similarity_topk"](spark, FOLDER).select("q_task_id").distinct().count()
    assert found == count("SELECT count(*) FROM {events} WHERE ts > (SELECT min(ts) FROM {events})")


def test_recency_weighted_median_answers_every_task(spark):
    found = catalogue.QUERIES["recency_weighted_median"](spark, FOLDER)
    assert found.count() == count("SELECT count(*) FROM {events}")
    assert found.where("recency_median is null").count() == 1  # the first alone has no past


@pytest.mark.parametrize("name", ["manhattan_knn", "euclidean_knn"])
def test_every_vector_with_a_past_has_its_nearest(spark, name):
    found = catalogue.QUERIES[name](spark, FOLDER).select("q_task_id").distinct().count()
    assert found == duckdb.sql(f"SELECT count(*) - 1 FROM '{FOLDER}/embeddings.parquet'").fetchall()[0][0]


@pytest.mark.parametrize("name", ["retrieval_three_stage", "prompt_refusals"])
def test_every_prompt_is_answered(spark, name):
    rows = catalogue.QUERIES[name](spark, FOLDER)
    want = duckdb.sql(f"SELECT count(DISTINCT (conv_id, turn)) FROM '{FOLDER}/conversations.parquet'").fetchall()[0][0]
    assert rows.count() == rows.select("task_id").distinct().count() == want


def test_the_screen_measures_all_development_rows(spark):
    rows = {(x.corpus, x.result): x.n for x in catalogue.QUERIES["screen_results"](spark, FOLDER).collect()}
    n = duckdb.sql(f"SELECT count(DISTINCT (conv_id, turn)) FROM '{FOLDER}/conversations.parquet'").fetchall()[0][0]
    assert rows["all_rows", "diagnostic_only"] == int(n * 0.55) + int(n * 0.2) + int(n * 0.1)
    assert rows["all_rows", "recency_symmetric"] == rows["all_rows", "jaccard_symmetric"] == int(n * 0.1)


@pytest.mark.parametrize("name", ["symmetric_band", "local_asymmetric_band", "distance_normalised_band", "cqr_band"])
def test_bands_are_given_to_all_of_the_last_fifth(spark, name):
    rows = catalogue.QUERIES[name](spark, FOLDER)
    assert rows.count() == rows.select("task_id").distinct().count() == count("SELECT count(*) FROM {events} WHERE epoch_us(ts) // 1000 > (SELECT quantile_cont(epoch_us(ts) // 1000, 0.8) FROM {events})")


def test_nearest_in_cells_equals_brute_force_with_ties_and_unknown_cells(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(150), r.choice([None, 0, 1, 2, 3, 30, 31, 32]), float(i)) for i in range(400)]
    history = spark.createDataFrame(rows, "task_id long, ts long, cell long, y double")
    sim = F.round(1 / (1.0 + F.floor(F.abs(F.col("q_cell") - F.col("c_cell")) / 2)), 9)  # cells that differ by one are alike
    got = {x.q_task_id: [c.task_id for c in x.near or ()] for x in nearest_in_cells(history, history, ["cell"], sim, 5, 20).collect()}
    for task_id, ts, cell, _ in rows:
        key = lambda c: (0 if cell is None or c[2] is None else -1 / (1 + abs(cell - c[2]) // 2), -c[1], -c[0])  # noqa: B023, E731
        assert got.get(task_id, []) == [c[0] for c in sorted((c for c in rows if c[1] < ts), key=key)[:5]]
