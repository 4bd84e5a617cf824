import random

import numpy as np

from tallyloom.llm.toxicity import Toxicity, drop_toxic, fit, fit_ordinal, score

PLAIN = [f"plain{i}" for i in range(200)]
BAD = ["grobian", "schuft", "lump"]


def corpus(r, n):
    rows = []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.choice([10, 50, 200]))]
        toxic = int(r.random() < 0.2)
        for _ in range(toxic * r.choice([1, 3, 10])):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "en"]) + r.choice(["", ".", ","]))
        rows.append((i, " ".join(words).title(), toxic))
    return rows


def test_finds_held_out_toxic_rows_and_keeps_clean_ones(spark):
    rows = corpus(random.Random(4), 1500)
    docs = spark.createDataFrame([(i, t, "x", -1.0) for i, t, _ in rows] + [(5000, None, "x", 0.0), (5001, "", "x", 0.0), (None, "Grobian schuft lump", "x", 0.0), (5002, "plain1 " * 50_000 + "schuft", "x", 0.0)], "doc_id long, text string, source string, severity double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 1000] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    got = {g.doc_id: g for g in score(docs, model).collect()}
    assert len(got) == 1504
    assert [(t, got[i]) for i, t, y in rows if got[i].toxic != bool(y)] == []
    assert [got[i].toxic for i in (5000, 5001, None, 5002)] == [False, False, True, True]
    assert {got[i].grade for i, _, y in rows if y} <= {1, 2} and all(0 <= g.severity <= 2 for g in got.values())
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, g in got.items() if not g.toxic}


def test_bounded_fit_still_scores_every_row(spark):
    rows = corpus(random.Random(8), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    p = Toxicity(max_rows=500)
    right = sum(g.toxic == bool(rows[g.doc_id][2]) for g in score(docs, fit(docs, labels, p), p).collect())
    assert right >= 0.99 * len(rows)


def test_thresholds_are_ordered_and_weights_shared():
    r = np.random.default_rng(3)
    x = [np.flatnonzero(r.random(6) < 0.5) for _ in range(3000)]
    true = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0])
    z = np.array([true[i].sum() for i in x]) + r.logistic(size=3000)
    weights, cuts = fit_ordinal(x, (z > 1).astype(int) + (z > 3) + (z > 5), 6, Toxicity(rounds=2000))
    assert (np.diff(cuts) > 0).all() and np.abs(cuts - [1, 3, 5]).max() < 0.5 and np.abs(weights - true).max() < 0.5


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "grobian")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(x) for x in score(docs, fit(docs, labels)).collect()] == [(1, 0.0, 0, False)]
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_repeated_ids_and_texts_stay_within_the_bound(spark):
    rows = corpus(random.Random(9), 600)
    again = [(1, f"{t} {k}") for k, (_, t, _) in enumerate(rows * 4)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + again + [(2, rows[2][1])] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels, Toxicity(max_rows=400))
    assert score(docs, model).count() == 600 + 2400 + 3000
    plain = docs.where("doc_id > 2").select("doc_id", "text")
    whole = fit(plain, labels)  # copies of rows change nothing
    assert np.allclose(fit(plain.unionByName(plain), labels).weights, whole.weights)
