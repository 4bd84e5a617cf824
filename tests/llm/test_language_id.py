import random
import zlib

import pyarrow as pa

from tallyloom.llm.language_id import gram_counts, identify_languages

WORDS = {"aa": ["the", "thing", "with", "other", "oneth"], "bb": ["élan", "leaux", "éclair", "queau", "vieux"], "cc": ["über", "straße", "lichen", "schön", "zwecks"]}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "e"]) for _ in range(n))


def test_counts_do_not_cross_texts():
    both, one, two = (gram_counts(pa.array(x), 10) for x in (["ab c", None, "é1"], ["ab c"], ["é1"]))
    assert (both[0] == one[0]).all() and (both[2] == two[0]).all()
    assert one.sum() == 5 + 4 and two.sum() == 4 + 3 and both[1].sum() == 1


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(7)
    rows = [(i, text(r, lang := r.choice(sorted(WORDS)), r.choice([3, 30, 300])), lang, "s", 0.5) for i in range(600)]
    rows += [(1000, None, "aa", "s", 0.5), (1001, "", "bb", "s", 0.5), (1002, "12 34 !", None, "s", 0.5), (1003, text(r, "bb", 20), None, "s", 0.5), (None, text(r, "cc", 20), "cc", "s", 0.5), (1003, text(r, "bb", 20), None, "s", 0.5), (1004, "қазақша мәтін", "aa", "s", 0.5), (1005, text(r, "aa", 60_000), "aa", "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = identify_languages(spark, docs).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for i, _, lang, *_ in rows[:600]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by[i].score <= 1
        assert by[i].lang_pred == lang
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1005)] == ["und", "und", "und", "bb", "cc", "aa"]
    assert by[1000].score == 0 and by[1000].rejected and by[1004].rejected and not by[5].rejected


def test_labels_of_held_out_rows_are_not_used(spark):
    r = random.Random(9)
    rows = [(i, text(r, "aa" if i % 2 else "bb", 30), "aa" if i % 2 else "bb") for i in range(200)]
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted(identify_languages(spark, spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()) for x in (rows, swapped))
    assert a == b


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(x) for x in identify_languages(spark, docs).collect()] == [(1, False, "und", 0.0, True)]
    assert identify_languages(spark, docs.limit(0)).count() == 0
