from tallyloom.plans.source_queries import stream_pieces


def test_no_piece_holds_more_lines_of_a_file_than_stated(spark):
    lines = spark.range(1, 401).selectExpr("'a' file", "id line_no", "'x' line")
    pieces = [sorted(r.line_no for r in p.collect()) for p in stream_pieces(lines, 100)]
    assert [len(p) for p in pieces] == [16, 44, 100, 100, 100, 40]
    assert sum(pieces, []) == list(range(1, 401))
    assert lines.columns == ["file", "line_no", "line"]
