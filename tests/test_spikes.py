import datetime as dt

import numpy as np

from quillon.operators import spikes as K

SCHEMA = "reading_id long, sensor string, volume long, lanes int, period_s int, read_at timestamp, arrived_at timestamp, fault string, block int"
T0 = dt.datetime(2020, 1, 1)


def frame(spark, values, sensor="A", first=0, lanes=20):
    rows = []
    for i, v in enumerate(values):
        at = T0 + dt.timedelta(seconds=60 * i)
        rows.append((first + i, sensor, v, lanes, 60, at, at, "clash", 3))
    return spark.createDataFrame(rows, SCHEMA)


def series(n, seed=1, level=400):
    return np.random.default_rng(seed).poisson(level, n).tolist()


def test_faults_and_block_edges(spark):
    v = series(400)
    v[50], v[51] = 5000, 9
    v[120:123] = [800, 790, 810]
    v[200:204] = [800, 810, 805, 820]
    v[250:258] = [461] * 8
    v[270:277] = [462] * 7
    v[300], v[310] = None, -1
    want = {50: "impossible", 51: "spike", 310: "impossible", **dict.fromkeys(range(250, 258), "stuck"), **dict.fromkeys(range(120, 123), "spike")}
    for block in (4096, 64):
        got = {r.reading_id: r.fault for r in K.faulty_readings(frame(spark, v), block=block, halo=32).collect()}
        assert got == want


def test_sources_fold_and_repeats_count_once(spark):
    v = series(100)
    v[40] = 5
    a, b = frame(spark, v, " a "), frame(spark, v, "A")
    later = b.withColumn("arrived_at", b.read_at + __import__("pyspark.sql.functions", fromlist=["x"]).expr("interval 1 day"))
    got = [tuple(r)[:2] for r in K.faulty_readings(a.union(later)).collect()]
    assert got.count((40, "spike")) == 1


def test_empty_null_and_missing_limits(spark):
    assert K.faulty_readings(frame(spark, [])).count() == 0
    df = frame(spark, [5, None, 10**6, -3], None, lanes=None)
    assert {r.reading_id: r.fault for r in K.faulty_readings(df).collect()}[3] == "impossible"


def test_runs():
    assert K.still(np.array([1, 1, 2, 2, 2, 1]), 3).tolist() == [False, False, True, True, True, False]
    assert K.still(np.array([1, 1, 2, 2, 2, 1]), 2).tolist() == [True, True, True, True, True, False]
    assert K.still(np.array([], int), 3).tolist() == [] and K.still(np.array([7, 7]), 3).tolist() == [False, False]


def test_spike_on_a_steep_rise(spark):
    v = series(200, level=160)
    v[100:112] = [160, 165, 170, 608, 214, 225, 245, 260, 270, 280, 290, 300]
    v[112:] = series(88, 5, 310)
    assert {r.reading_id: r.fault for r in K.faulty_readings(frame(spark, v)).collect()} == {103: "spike"}


def test_quiet_sources_keep_their_own_scatter(spark):
    v = [400 + round(x) for x in np.random.default_rng(4).normal(0, 4, 400)]
    v[200] += 48
    got = {r.reading_id: r.fault for r in K.faulty_readings(frame(spark, v)).collect()}
    assert got == {200: "spike"}
