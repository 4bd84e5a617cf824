import hashlib
import random

import zstandard

from tallyloom.llm.warc import Warc, fetch_records, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload string, revisit int"


def want(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark, tmp_path):
    r = random.Random(1)
    shared = ["é" * 50, "x" * 99, "<p>\r\n\r\nWARC/1.1</p>" * 40, "y" * 100]
    rows = [(i, f"http://a/é {i}\r\nX: y", r.choice(shared) if r.random() < 0.5 else "z" * r.randrange(5000) + str(i)) for i in range(400)]
    rows += [(500, None, None), (501, "", ""), (None, "http://n", "y" * 100), (None, "http://n", "n" * 200), (502, "u", "L" * 3_000_000), (502, "u", "L" * 3_000_000), (503, "u", "L" * 3_000_000), (502, "u", "y" * 100)]
    r.shuffle(rows)
    pages = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(3)
    folder, p = str(tmp_path / "archives"), Warc(frame=4096, bundle=1 << 15)
    write_archives(pages, folder, p).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == len(rows) and index.select("bundle").distinct().count() > 1
    back = read_archives(index, folder, payloads=True).collect()
    assert sorted(str(tuple(x)[:5]) for x in back) == want(rows)
    html = {(i, h or "") for i, _, h in rows}
    assert all((x.page_id, bytes(x.payload).decode()) in html for x in back if x.record_type == "response")
    # any Zstandard reader reads a bundle, and the index leads to single records
    file = next((tmp_path / "archives").iterdir())
    assert zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True).read(8) == b"WARC/1.1"
    wanted = spark.createDataFrame([(f"<urn:x-page:{i}>",) for i in (3, 77, 399)], "record_id string")
    by = {i: h for i, _, h in rows}
    got = fetch_records(index, wanted, folder).collect()
    assert len(got) == 3
    for x in got:
        if x.record_type == "response":
            assert bytes(x.payload).decode() == by[int(x.record_id[12:-1])]


def test_empty(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).write.parquet(str(tmp_path / "index"))
    assert read_archives(spark.read.parquet(str(tmp_path / "index")), str(tmp_path / "a")).count() == 0
