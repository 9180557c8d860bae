from quillon.operators import tables


def test_box_takes_its_range_from_the_data(spark):
    df = spark.createDataFrame([(x, float(x)) for x in range(-3, 1500)] + [(None, 7.0)], "x long, y double")
    got = {r.slice: r.levels for r in tables.box_and_whisker(df, "x", "y").collect()}
    assert sorted(got) == list(range(8)) and got[0][0] == -3.0 and got[7][-1] == 1499.0
    assert {r.slice for r in tables.box_and_whisker(df, "x", "y", 0, 200, 8).collect()} == set(range(8))
    assert [tuple(r) for r in tables.box_and_whisker(df.where("x = 5"), "x", "y").collect()] == [(0, [5.0] * 5)]
    assert tables.box_and_whisker(df.limit(0), "x", "y").count() == 0
