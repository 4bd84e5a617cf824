import json
import random

from tallyloom.sources.json_arrays import json_array_elements


def element(r, i):
    odd = ['}', '{', ']', '[', '"', "\\", '\\"', "}\\\\", "},{", "é ", "\n", " ", "x" * r.randint(0, 40)]
    text = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 8)))
    return {"id": i, text(): text(), "list": [{"a": text(), "deep": [[{}], {"b": {"c": text()}}]} for _ in range(r.randint(0, 3))], "none": None}


def read(spark, folder):
    rows = json_array_elements(spark, str(folder)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.file, r.place)):
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.element))
    return found


def test_elements_of_files_cut_into_many_ranges(spark, tmp_path):
    r = random.Random(4)
    want = {f"{k}.json": [element(r, i) for i in range(n)] for k, n in (("a", 300), ("b", 1), ("c", 0), ("d", 40))}
    for k, (name, rows) in enumerate(want.items()):
        (tmp_path / name).write_text(json.dumps(rows, indent=[None, 2][k % 2], ensure_ascii=bool(k // 2)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "997b", "131b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert read(spark, tmp_path) == {k: v for k, v in want.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_file_that_breaks_off_loses_its_last_element(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a": "}"}, {"b": [1, {"c": 2}, {"d"')
    (tmp_path / "open.json").write_text('[{"a": 1}, {"b": 2}')
    (tmp_path / "other.json").write_text('"text"')
    assert read(spark, tmp_path) == {"cut.json": [{"a": "}"}], "open.json": [{"a": 1}]}
