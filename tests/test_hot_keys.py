"""One key holds nine rows in ten: running work must not meet it in one task, and must agree with a plain loop."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, tables, windows

BY, ORDER = ("k",), ("i",)


@pytest.fixture(autouse=True, params=[50, 10**9], ids=["pieces", "whole"])
def hot_rows(request, monkeypatch):
    """Both ways: a key of 50 rows is split, or none is."""
    monkeypatch.setattr(blocks, "HOT_ROWS", request.param)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    data = [(i, "hot" if i % 10 else r.choice(["a", "b", None]), None if r.random() < 0.05 else round(r.gauss(0, 3), 3), r.choice([0, 0, 1, 2])) for i in range(3000)]
    r.shuffle(data)
    return data, spark.createDataFrame(data, "i long, k string, x double, g long")


def by_key(data):
    out = {}
    for i, k, x, g in sorted(data):
        out.setdefault(k, []).append((i, x, g))
    return out


def check(df, col, want):
    got = {r.i: r[col] for r in df.collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert (got[i] is None and w is None) or got[i] == pytest.approx(w, abs=1e-9), (i, got[i], w)


def test_pieces_are_small(rows):
    data, df = rows
    sizes = [r["count"] for r in blocks.placed(df, BY, ORDER, 8).groupBy(blocks.PIECE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * len(data)


def loop(data, step):
    want = {}
    for items in by_key(data).values():
        state = None
        for i, x, g in items:
            state, want[i] = step(state, x, g)
    return want


@pytest.mark.parametrize("kind", ["count", "sum", "average", "min", "max"])
def test_running(rows, kind):
    data, df = rows

    def step(seen, x, _):
        seen = [*(seen or []), *([] if x is None else [x])]
        return seen, {"count": len(seen), "sum": float(sum(seen)), "average": sum(seen) / len(seen) if seen else None, "min": min(seen, default=None), "max": max(seen, default=None)}[kind]

    check(windows.running(df, F.col("x"), kind, BY, ORDER, "r"), "r", loop(data, step))


def test_cusums_and_exponential(rows):
    data, df = rows
    cusum = loop(data, lambda s, x, _: 2 * ((s or 0.0) if x is None else max(0.0, (s or 0.0) + x),))
    check(windows.cusum(df, F.col("x"), BY, ORDER, "r"), "r", cusum)
    check(windows.cusum_exact(df, "x", BY, ORDER, "r"), "r", cusum)
    mean, var = {}, {}
    for items in by_key(data).values():
        m = v = None
        for i, x, _ in items:
            if x is not None:
                if m is None:
                    m, v = x, 0.0
                else:
                    v = 0.9 * (v + 0.1 * (x - m) ** 2)
                    m = 0.1 * x + 0.9 * m
            mean[i], var[i] = m, v
    df2 = windows.exponential(df, "x", 0.1, BY, ORDER, "r", "v")
    check(df2, "r", mean)
    check(df2, "v", var)


def test_unweighted_moments(rows):
    data, df = rows
    out = windows.unweighted(df, F.col("x"), BY, ORDER)

    def var(seen, x, _):
        seen = [*(seen or []), *([] if x is None else [x])]
        return seen, float(np.var(seen, ddof=1)) if len(seen) > 1 else None

    check(out, "w_var", loop(data, var))
    check(out, "w_count", loop(data, lambda n, x, _: 2 * ((n or 0) + (x is not None),)))


def test_carry_forward_runs_and_places(rows):
    data, df = rows
    check(windows.carry_forward(df, "g", BY, ORDER, "r"), "r", loop(data, lambda s, _, g: 2 * (g or s or 0,)))

    def run(state, _, g):
        last, n = state or (object(), 0)
        n += g != last
        return (g, n), n

    check(windows.runs(df, "g", BY, ORDER, "r"), "r", loop(data, run))
    check(blocks.numbered(df, BY, ORDER, "r"), "r", loop(data, lambda n, *_: 2 * (0 if n is None else n + 1,)))


def test_bounded_windows_by_blocks(rows, monkeypatch):
    data, df = rows
    real = blocks.in_blocks
    monkeypatch.setattr(blocks, "in_blocks", lambda *a: real(*a[:6], block=50))
    want = {i: (None if n < 3 else items[n - 3][2]) for items in by_key(data).values() for n, (i, *_) in enumerate(items)}
    check(windows.shift(df, "g", 3, None, BY, ORDER, "r"), "r", want)
    want = {i: (0 if n == 0 else items[n][2] - items[n - 1][2]) for items in by_key(data).values() for n, (i, *_) in enumerate(items)}
    check(windows.delta(df, "g", BY, ORDER, "r"), "r", want)
    want = {i: n + 1 == len(items) or items[n + 1][2] != items[n][2] for items in by_key(data).values() for n, (i, *_) in enumerate(items)}
    check(windows.unique_mask(df, "g", BY, ORDER, True, "r"), "r", want)
    want = {i: float(sum(g for *_, g in items[max(0, n - 4) : n + 1])) for items in by_key(data).values() for n, (i, *_) in enumerate(items)}
    check(windows.windowed(df, F.col("g"), 5, 0, BY, ORDER), "w_sum", want)


def test_grouped_view(rows):
    data, df = rows
    got = {r.i: r.m for r in windows.grouped_view(df.where("x is not null"), "k", F.col("x"), ORDER, "m").collect()}
    sums, want = {}, {}
    for i, k, x, _ in sorted(data):
        if x is not None:
            if k is not None:
                sums[k] = sums.get(k, 0.0) + x
            want[i] = dict(sums)
    assert got.keys() == want.keys() and all(got[i].keys() == want[i].keys() and all(got[i][k] == pytest.approx(want[i][k]) for k in want[i]) for i in want)


def test_percentiles(rows):
    data, df = rows
    got = {r.k: r.levels for r in blocks.percentiles(df, ["k"], "x", (0, 0.25, 0.5, 0.9, 1)).collect()}
    frame = pd.DataFrame(data, columns=["i", "k", "x", "g"])
    for k in ("hot", "a", "b", None):
        mine = frame[frame.k.isna() if k is None else frame.k == k].x.dropna()
        assert got[k] == pytest.approx(np.quantile(mine, [0, 0.25, 0.5, 0.9, 1]).tolist())
    assert blocks.percentiles(df.where("x is null"), ["k"], "x", (0.5,)).count() == 0


def test_top_and_segment_totals(rows):
    data, df = rows
    assert {(r.field, r.value) for r in tables.top_by_field(df, ["k", "g"], 1).collect()} == {("k", "hot"), ("g", "0")}
    got = {r.k: r.event_count for r in tables.segment_counts(df, "k", "g").collect()}
    assert got == {k: sum(g for *_, g in items) for k, items in by_key(data).items()}


def test_empty_tables(rows):
    _, df = rows
    none = df.where("i < 0")
    for out in (windows.running(none, F.col("x"), "sum", BY, ORDER, "r"), windows.cusum_exact(none, "x", BY, ORDER, "r"), windows.exponential(none, "x", 0.5, BY, ORDER), windows.shift(none, "x", 1, None, BY, ORDER, "r"), windows.grouped_view(none, "k", F.col("x"), ORDER, "m"), windows.unweighted(none, F.col("x"), BY, ORDER)):
        assert out.count() == 0
