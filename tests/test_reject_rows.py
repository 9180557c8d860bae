import pytest

from quillon.operators import reject_rows as R

SCHEMA = "line_id long, feed string, line_text string, reason string, volume double, row int"


def run(spark, lines):
    rows = [(i, f, t, "clash", 1.0, 7) for i, (f, t) in enumerate(lines)]
    return {r.line_id: r for r in R.split_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_reasons(spark):
    t, w = "test_data", "wtraining_converted"
    lines = [
        (t, "A\t5"), (t, '"A\t5'), (t, 'A"B\t5'), (t, '"A"x\t5'), (t, "A\t5\t6"), (t, "A"), (t, "A\tx"), (t, "A\t 5 "), (t, "A\t"), (t, '"A\tB"\t"7"'), (t, 'say ""\t1'), (t, '"say ""hi"""\t1'),
        (t, "sensor\tvolume\r"), (t, "﻿A\t5\r"), (t, ""), (t, "   "), (t, None), (t, "\t\t"), (t, "A\t1234567890"), (t, "A\t٣"), (t, "A\nB\t3"), (t, "A\t3\n"), (t, "A\rB\t3"), (t, "1\t3"),
        (w, "1\t2001-02-29\tRed\tX"), (w, "1\t2000-02-29\tRed\tX"), (w, "\t\t\t"), (w, "1\t2001-2-3\tR\tX"), (w, "1\t0000-01-01\tR\tX"), (w, "1\t2001-01-01\tR"), (None, "A\t1"), ("other", "A\t1"),
    ]
    got = run(spark, lines)
    want = {1: "quoting", 2: "quoting", 3: "quoting", 4: "columns", 5: "columns", 6: "value", 10: "quoting", 17: "columns", 18: "value", 19: "value", 21: "value", 24: "value", 27: "value", 28: "value", 29: "columns"}
    assert {k: r.reason for k, r in got.items() if r.reason} == want
    assert set(range(len(lines))) - set(got) == {12, 14, 15, 16, 30, 31}
    assert got[9].sensor == "A\tB" and got[9].volume == 7 and got[11].sensor == 'say "hi"'
    assert got[7].volume == 5 and got[8].volume is None and got[20].sensor == "A\nB" and got[22].sensor == "A\rB" and got[23].sensor == "1"
    assert str(got[25].date) == "2000-02-29" and got[24].bad_field == "date" and got[26].reason is None


def test_repeats_and_empty(spark):
    assert R.split_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "test_data", "x", "", 0.0, 0)] * 3 + [(2, "test_data", "A\t2", "", 0.0, 0)] * 2, SCHEMA)
    parsed = R.split_lines(df)
    assert [tuple(r) for r in R.rejects(parsed).collect()] == [(1, "columns")]
    assert R.sound_rows(parsed, R.FEEDS[0]).count() == 1


@pytest.mark.parametrize("size", [10_000, 300_000])
def test_very_long_line(spark, size):
    got = run(spark, [("test_data", "y" * size + "\t3"), ("test_data", '"' + "y" * size)])
    assert got[0].volume == 3 and len(got[0].sensor) == size and got[1].reason == "quoting"
