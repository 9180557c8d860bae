"""Order-dependent operators: running and windowed aggregates, event weighting and vector operations.

Rows of a table have no order, so each operator takes one, which must be unique within a key; keys in ``by``
split the rows. A key may hold any share of the rows: running work goes by pieces of a key and what the pieces before
leave, bounded windows by blocks with copies of their neighbours' nearest rows (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import blocks


def running(df: DataFrame, x: Column, kind: str, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """count, sum, average, min or max of the rows up to each row; null x is skipped."""
    value = x.cast("double") if kind in ("sum", "average") else x
    rows = blocks.placed(df.withColumn("__x", value), by, order)
    w = blocks.local(by, order)
    rows = rows.withColumns({"__c": F.count("__x").over(w), "__v": F.min("__x").over(w) if kind == "min" else F.max("__x").over(w) if kind == "max" else F.sum("__x").over(w) if kind != "count" else F.lit(0.0)})
    fold = {"min": F.min, "max": F.max}.get(kind, F.sum)
    summary = {"__n": F.count("__x"), "__t": fold("__x") if kind != "count" else F.lit(0.0)}
    rows = blocks.with_carry(rows, by, summary, lambda e: {"__n0": F.sum("__n").over(e), "__t0": fold("__t").over(e)})
    count = F.col("__c") + F.coalesce("__n0", F.lit(0))
    total = F.coalesce("__v", F.lit(0.0)) + F.coalesce("__t0", F.lit(0.0))
    made = {"count": lambda: count, "sum": lambda: total, "average": lambda: F.try_divide(total, count), "min": lambda: F.least("__v", "__t0"), "max": lambda: F.greatest("__v", "__t0")}
    return rows.withColumn(out, made[kind]()).drop("__x", "__c", "__v", "__n0", "__t0", blocks.PIECE)


def prefix_sum(df: DataFrame, x: Column, order: Sequence[str], out: str, pieces: int | None = None) -> DataFrame:
    """Running total over all rows in two steps: sums within pieces, plus the pieces' offsets. Null x counts as 0."""
    rows = blocks.placed(df.withColumn("__x", F.coalesce(x.cast("double"), F.lit(0.0))), [], order, pieces)
    rows = rows.withColumn("__l", F.sum("__x").over(blocks.local([], order)))
    rows = blocks.with_carry(rows, [], {"__t": F.sum("__x")}, lambda e: {"__o": F.sum("__t").over(e)})
    return rows.withColumn(out, F.col("__l") + F.coalesce("__o", F.lit(0.0))).drop("__x", "__l", "__o", blocks.PIECE)


def continued(df: DataFrame, x: Column, by: Sequence[str], order: Sequence[str], state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with run_count and run_sum, state): running count and sum that go on from a saved state.

    ``state`` has the keys and state_count, state_sum; keys absent from this batch are carried forward.
    """
    value = x.cast("double")
    rows = running(running(df, value, "count", by, order, "run_count"), value, "sum", by, order, "run_sum")
    now = df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    if state is None:
        return rows, now.select(*by, F.col("n").alias("state_count"), F.col("s").alias("state_sum"))
    out = rows.join(state, list(by), "left").na.fill({"state_count": 0, "state_sum": 0.0})
    out = out.withColumns({"run_count": F.col("run_count") + F.col("state_count"), "run_sum": F.col("run_sum") + F.col("state_sum")}).drop("state_count", "state_sum")
    both = state.join(now, list(by), "full").na.fill({"state_count": 0, "state_sum": 0.0, "n": 0, "s": 0.0})
    return out, both.select(*by, (F.col("state_count") + F.col("n")).alias("state_count"), (F.col("state_sum") + F.col("s")).alias("state_sum"))


def grouped_view(df: DataFrame, group: str, x: Column, order: Sequence[str], out: str) -> DataFrame:
    """Each row with a map of group → running sum over all groups seen so far; null groups are left out.

    Maps are built within pieces; each piece then adds the map of all pieces before it.
    """
    kind = dict(df.dtypes)[group]

    def step(part: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        state, made = dict(state), []
        for g, v in zip(part[group], part["__x"], strict=True):
            if not pd.isna(g):
                old = state.get(g)
                state[g] = old if pd.isna(v) else v + (old or 0.0)
            made.append(list(state.items()))
        return pd.DataFrame({"__m": made}), state

    rows = blocks.scanned(df.withColumn("__x", x.cast("double")), [], order, f"__m array<struct<k:{kind},v:double>>", step)
    rows = rows.withColumn("__m", F.map_from_entries("__m"))
    # One row for each piece and group.
    sums = rows.where(F.col(group).isNotNull()).groupBy(blocks.PIECE, group).agg(F.sum("__x").alias("s"))
    pieces = rows.select(blocks.PIECE).distinct().withColumnRenamed(blocks.PIECE, "__kp")
    upto = sums.join(F.broadcast(pieces), F.col(blocks.PIECE) < F.col("__kp")).groupBy("__kp", group).agg(F.sum("s").alias("s"))
    before = upto.groupBy("__kp").agg(F.map_from_entries(F.collect_list(F.struct(F.col(group).alias("k"), F.col("s").alias("v")))).alias("__b"))
    both = rows.join(before, F.col(blocks.PIECE) == F.col("__kp"), "left")
    added = F.map_zip_with("__m", "__b", lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
    return both.withColumn(out, F.when(F.col("__b").isNull(), F.col("__m")).otherwise(added)).drop("__m", "__b", "__x", "__kp", blocks.PIECE)


def top_contribution(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """The bin that adds most to the scalar product, and its part."""
    o = observed.groupBy("bin").agg(F.sum("count").cast("double").alias("o"))
    e = expected.groupBy("bin").agg(F.sum("count").cast("double").alias("e"))
    part = F.col("o") * F.col("e")
    return o.join(e, "bin").agg(F.max_by("bin", part).alias("bin"), F.max(part).alias("part"))


def aggregate_reduce(df: DataFrame, group: str, x: Column, inner: str, outer: str) -> DataFrame:
    """An aggregate over the groups of another one."""
    fns = {"count": F.count, "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}
    return df.groupBy(group).agg(fns[inner](x).alias("__v")).agg(fns[outer]("__v").alias("value"))


def multiset(df: DataFrame, group: str, x: str) -> DataFrame:
    """(group, value → count) of each group, pre-aggregated by value before the map is built."""
    counts = df.where(F.col(x).isNotNull()).groupBy(group, x).count()
    return counts.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(x), F.col("count"))))).alias("multiset"))


# Event weighting.


def windowed(df: DataFrame, x: Column, size: int, lag: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Moments of the last ``size`` rows after skipping the ``lag`` newest: w_count, w_mean, w_var, w_min, w_max, w_sum."""
    return blocks.in_blocks(df, by, order, lag + size - 1, 0, lambda rows, w, _: _moments(rows, x, w().rowsBetween(-(lag + size - 1), -lag)))


def synchronised(df: DataFrame, x: Column, sync: str, size: int, lag: int, by: Sequence[str], block: int = 4096) -> DataFrame:
    """Moments of rows whose whole-number ``sync`` lies in (now - lag - size, now - lag]; by blocks of ``sync``."""
    reach = lag + size - 1
    block = max(block, reach)
    here, offset = F.floor(F.col(sync) / block), F.pmod(F.col(sync), F.lit(block))
    copies = F.array_compact(F.array(F.struct(here.alias("b"), F.lit(True).alias("core")), F.when(offset >= block - reach, F.struct((here + 1).alias("b"), F.lit(False).alias("core")))))
    rows = df.withColumn("__c", F.explode(copies)).withColumns({"__b": F.col("__c.b"), "__core": F.col("__c.core")}).drop("__c")
    done = _moments(rows, x, W.partitionBy(*by, "__b").orderBy(sync).rangeBetween(-reach, -lag))
    return done.where("__core").drop("__b", "__core")


def unweighted(df: DataFrame, x: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Moments of all rows up to each; those of earlier segments are merged in by their counts and means."""
    rows = blocks.placed(df.withColumn("__x", x.cast("double")), by, order)
    w = blocks.local(by, order)
    rows = rows.withColumns({"__c": F.count("__x").over(w), "__m": F.avg("__x").over(w), "__q": F.var_pop("__x").over(w) * F.count("__x").over(w), "__lo": F.min("__x").over(w), "__hi": F.max("__x").over(w)})
    # Moments about the key's own first mean, so that no digits cancel between segments.
    summary = {"__n": F.count("__x"), "__a": F.avg("__x"), "__s": F.var_pop("__x") * F.count("__x"), "__l": F.min("__x"), "__h": F.max("__x")}

    def carry(e: WindowSpec) -> dict[str, Column]:
        parts = F.filter(F.collect_list(F.struct(F.col("__n").cast("double").alias("n"), F.col("__a").alias("a"), F.col("__s").alias("s"))).over(e), lambda p: p["n"] > 0)
        return {"__z": F.aggregate(parts, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("s")), lambda p, q: _merged(p, q["n"], q["a"], q["s"])), "__l0": F.min("__l").over(e), "__h0": F.max("__h").over(e)}

    rows = blocks.with_carry(rows, by, summary, carry)
    start = F.coalesce("__z", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("s")))
    rows = rows.withColumn("__t", F.when(F.col("__c") > 0, _merged(start, F.col("__c").cast("double"), F.col("__m"), F.col("__q"))).otherwise(start))
    n = F.col("__t.n")
    some = {"w_sum": n * F.col("__t.a"), "w_mean": F.col("__t.a")}
    made = {"w_count": n.cast("long"), **{k: F.when(n > 0, v) for k, v in some.items()}, "w_var": F.when(n >= 2, F.col("__t.s") / (n - 1)), "w_min": F.least("__lo", "__l0"), "w_max": F.greatest("__hi", "__h0")}
    return rows.withColumns(made).drop("__x", "__c", "__m", "__q", "__lo", "__hi", "__z", "__l0", "__h0", "__t", blocks.PIECE)


def _merged(p: Column, n: Column, a: Column, s: Column) -> Column:
    """(count, mean, sum of squares about it) of two parts; the second is not empty."""
    total, gap = p["n"] + n, a - p["a"]
    return F.struct(total.alias("n"), (p["a"] + gap * n / total).alias("a"), (p["s"] + s + gap * gap * p["n"] * n / total).alias("s"))


def _moments(df: DataFrame, x: Column, frame: WindowSpec) -> DataFrame:
    x = x.cast("double")
    var = F.when(F.count(x).over(frame) >= 2, F.var_samp(x).over(frame))
    return df.withColumns({"w_count": F.count(x).over(frame), "w_sum": F.sum(x).over(frame), "w_mean": F.avg(x).over(frame), "w_var": var, "w_min": F.min(x).over(frame), "w_max": F.max(x).over(frame)})


def exponential(df: DataFrame, x: str, alpha: float, by: Sequence[str], order: Sequence[str], out: str = "ewma", variance: str | None = None) -> DataFrame:
    """m₁ = x₁, m = α·x + (1 - α)·m; with ``variance`` also v₁ = 0, v = (1 - α)·(v + α·(x - m)²). Null x repeats both.

    Each segment is scanned from the key's first value, as the first one must be; the others then take up what the
    segments before leave, which decays by (1 - α) a row. v is the weighted mean of x² less m², about that first value.
    """
    keep = 1 - alpha

    def step(part: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        v, f = part["__y"].to_numpy(dtype=float), float(part["__f"].iloc[0] if part["__f"].iloc[0] is not None else np.nan)
        m, q, k = state.get("m", f), state.get("q", 0.0), state.get("k", 0)
        ms, qs, ks = np.empty(len(v)), np.empty(len(v)), np.empty(len(v), np.int64)
        for i, a in enumerate(v.tolist()):
            if a == a:
                m, q, k = keep * m + alpha * a if a != m else m, keep * q + alpha * (a - f) * (a - f), k + 1
            ms[i], qs[i], ks[i] = m, q, k
        return pd.DataFrame({"__m": ms, "__q": qs, "__k": ks}), {"m": m, "q": q, "k": k}

    # The key's first value by order: one row a key.
    value = F.col(x).cast("double")
    place = F.struct(*order)
    first = df.where(value.isNotNull()).groupBy(*by).agg(F.min_by(value, place).alias("__f"))
    on = F.lit(True)
    for i, b in enumerate(by):
        first = first.withColumnRenamed(b, f"__g{i}")
        on = on & F.col(b).eqNullSafe(F.col(f"__g{i}"))
    joined = df.join(first, on, "left").drop(*[f"__g{i}" for i in range(len(by))])
    rows = blocks.scanned(joined.withColumn("__y", value), by, order, "__m double, __q double, __k bigint", step)
    end = F.max_by(F.struct((F.col("__m") - F.col("__f")).alias("__m"), "__q", "__k"), place)

    def carry(e: WindowSpec) -> dict[str, Column]:
        # At most one entry a piece.
        ends = F.collect_list("__e").over(e)
        start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
        return {"__s": F.aggregate(ends, start, lambda s, t: F.struct((t["__m"] + s["m"] * F.pow(F.lit(keep), t["__k"].cast("double"))).alias("m"), (t["__q"] + s["q"] * F.pow(F.lit(keep), t["__k"].cast("double"))).alias("q"))), "__kb": F.sum(F.col("__e.__k")).over(e)}

    rows = blocks.with_carry(rows, by, {"__e": end}, carry)
    left = F.pow(F.lit(keep), F.col("__k").cast("double"))
    value = F.col("__m") + F.coalesce(F.col("__s.m"), F.lit(0.0)) * left
    m = value - F.col("__f")
    q = F.col("__q") + F.coalesce(F.col("__s.q"), F.lit(0.0)) * left
    seen = F.col("__k") + F.coalesce("__kb", F.lit(0)) > 0
    made = {out: F.when(seen, value)}
    if variance:
        made[variance] = F.when(seen, F.greatest(F.lit(0.0), q - m * m))
    return rows.withColumns(made).drop("__f", "__y", "__m", "__q", "__k", "__s", "__kb", blocks.PIECE)


# Vector operations.


def shift(df: DataFrame, x: str, k: int, filler: object, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Value ``k`` rows before (k > 0) or after (k < 0)."""
    return blocks.in_blocks(df, by, order, max(k, 0), max(-k, 0), lambda rows, w, _: rows.withColumn(out, F.lag(x, k, filler).over(w()) if k >= 0 else F.lead(x, -k, filler).over(w())))


def delta(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Difference to the previous row, 0 for the first."""
    return blocks.in_blocks(df, by, order, 1, 0, lambda rows, w, pos: rows.withColumn(out, F.when(F.col(pos) == 0, F.col(x) * 0).otherwise(F.col(x) - F.lag(x).over(w()))))


def carry_forward(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zeros become the last non-zero value before them; leading zeros stay."""
    filled = F.when(F.col(x) != 0, F.col(x))
    rows = blocks.placed(df, by, order).withColumn("__l", F.last(filled, ignorenulls=True).over(blocks.local(by, order)))
    end = F.max_by(filled, F.when(filled.isNotNull(), F.struct(*order)))
    rows = blocks.with_carry(rows, by, {"__e": end}, lambda e: {"__b": F.last("__e", ignorenulls=True).over(e)})
    return rows.withColumn(out, F.coalesce("__l", "__b", F.col(x) * 0)).drop("__l", "__b", blocks.PIECE)


def look_ahead(df: DataFrame, x: str, step: float, by: Sequence[str], first: bool, out: str) -> DataFrame:
    """On sorted values: position of the first or last row holding x + step, or the next lower value there is.

    Position counts from 0 within the key. A row frame by value finds the matched value; its position is
    that value's smallest or largest.
    """
    w = W.partitionBy(*by).orderBy(x)
    placed = df.withColumn("__i", F.row_number().over(w) - 1)
    keys = f"partition by {', '.join(f'`{b}`' for b in by)} " if by else ""
    matched = placed.withColumn("__v", F.expr(f"max(`{x}`) over ({keys}order by `{x}` range between unbounded preceding and {float(step)!r}D following)"))
    spots = placed.groupBy(*by, F.col(x).alias("__v")).agg((F.min("__i") if first else F.max("__i")).alias(out))
    return matched.join(spots, [*by, "__v"], "left").drop("__i", "__v")


def window_apply(df: DataFrame, x: str, step: int, by: Sequence[str], order: Sequence[str], out: str, kind: str = "sum") -> DataFrame:
    """Sliding chunks of ``step`` rows, one output for each row from the step-th on; the first chunk leaves row 0 out.

    ``kind`` is sum, range (largest less smallest), average, min, max or count. Empty chunks are dropped, but for sums.
    """
    fns = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count}

    def run(rows: DataFrame, w: Callable[[], WindowSpec], pos: str) -> DataFrame:
        value = lambda f: F.max(x).over(f) - F.min(x).over(f) if kind == "range" else fns[kind](x).over(f)
        full = value(w().rowsBetween(-(step - 1), 0))
        if step > 1:
            head = value(w().rowsBetween(-(step - 2), 0))
            head = F.coalesce(head, F.lit(0)) if kind == "sum" else head
        else:
            head = F.col(x) * 0 if kind == "sum" else F.lit(None)
        rows = rows.withColumn(out, F.when(F.col(pos) == step - 1, head).otherwise(full)).where(F.col(pos) >= step - 1)
        return rows if kind == "sum" else rows.where(F.col(out).isNotNull())

    return blocks.in_blocks(df, by, order, step - 1, 0, run)


def unique_mask(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], last: bool, out: str) -> DataFrame:
    """Flags the last (or first) row of each run of equal values."""

    def run(rows: DataFrame, w: Callable[[], WindowSpec], pos: str) -> DataFrame:
        beside = (F.lead if last else F.lag)(F.struct(F.col(x).alias("v"))).over(w())
        return rows.withColumn(out, beside.isNull() | ~F.col(x).eqNullSafe(beside["v"]))

    return blocks.in_blocks(df, by, order, 0 if last else 1, 1 if last else 0, run)


def runs(df: DataFrame, key: str, by: Sequence[str], order: Sequence[str], out: str = "run_no") -> DataFrame:
    """Numbers the runs of consecutive equal keys, from 1."""

    def mark(rows: DataFrame, w: Callable[[], WindowSpec], pos: str) -> DataFrame:
        return rows.withColumn("__s", F.when((F.col(pos) == 0) | ~F.col(key).eqNullSafe(F.lag(key).over(w())), 1).otherwise(0))

    marked = blocks.in_blocks(df, by, order, 1, 0, mark)
    return running(marked, F.col("__s"), "sum", by, order, out).withColumn(out, F.col(out).cast("long")).drop("__s")


# Change detection.


def cusum(df: DataFrame, x: Column, by: Sequence[str], order: Sequence[str], out: str, reset: float = 0.0) -> DataFrame:
    """S = max(reset, S + x) from 0, in closed form: running sums and their least, no loop. Null x repeats S."""
    rows = blocks.placed(df.withColumn("__x", x.cast("double")), by, order)
    w = blocks.local(by, order)
    rows = rows.withColumn("__c", F.coalesce(F.sum("__x").over(w), F.lit(0.0)))
    sure = F.when(F.col("__x").isNotNull(), F.col("__c"))
    rows = rows.withColumn("__l", F.min(sure).over(w))
    rows = blocks.with_carry(rows, by, {"__t": F.coalesce(F.sum("__x"), F.lit(0.0)), "__m": F.min(sure)}, lambda e: {"__c0": F.coalesce(F.sum("__t").over(e), F.lit(0.0)), "__l0": F.min(F.col("__m") + F.col("__c0")).over(e)})
    total = F.col("__c") + F.coalesce("__c0", F.lit(0.0))
    lowest = F.least(F.col("__l") + F.coalesce("__c0", F.lit(0.0)), F.col("__l0"))
    return rows.withColumn(out, total + F.coalesce(F.greatest(F.lit(0.0), F.lit(reset) - lowest), F.lit(0.0))).drop("__x", "__c", "__l", "__c0", "__l0", blocks.PIECE)


def cusum_exact(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], out: str, reset: float = 0.0) -> DataFrame:
    """The same by the recurrence itself, without cancellation.

    Over a segment S becomes max(a, S + b); each row's a and b are scanned, and the segments before give its S.
    """

    def step(part: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
        a, b, top, total = state.get("a", float("-inf")), state.get("b", 0.0), [], []
        for v in part["__y"].to_numpy(dtype=float).tolist():
            if v == v:
                a, b = max(reset, a + v), b + v
            top.append(a)
            total.append(b)
        return pd.DataFrame({"__a": top, "__t": total}), {"a": a, "b": b}

    rows = blocks.scanned(df.withColumn("__y", F.col(x).cast("double")), by, order, "__a double, __t double", step)
    end = F.max_by(F.struct("__a", "__t"), F.struct(*order))
    rows = blocks.with_carry(rows, by, {"__e": end}, lambda e: {"__s": F.aggregate(F.collect_list("__e").over(e), F.lit(0.0), lambda s, t: F.greatest(t["__a"], s + t["__t"]))})
    return rows.withColumn(out, F.greatest(F.col("__a"), F.coalesce("__s", F.lit(0.0)) + F.col("__t"))).drop("__y", "__a", "__t", "__s", blocks.PIECE)


def windowed_cusum(df: DataFrame, x: Column, size: int, by: Sequence[str], order: Sequence[str], out: str, reset: float = 0.0) -> DataFrame:
    """CUSUM that starts anew at the oldest row of each window of ``size`` rows."""
    fold = lambda w: F.aggregate(F.collect_list(x.cast("double")).over(w.rowsBetween(-(size - 1), 0)), F.lit(0.0), lambda a, v: F.greatest(F.lit(reset), a + v))
    return blocks.in_blocks(df, by, order, size - 1, 0, lambda rows, w, _: rows.withColumn(out, fold(w())))


def glr(df: DataFrame, x: Column, size: int, by: Sequence[str], order: Sequence[str], mean: float, variance: float | None = None) -> DataFrame:
    """Generalised likelihood ratio over the suffixes of each window of ``size`` rows: glr, and glr_back, the
    number of rows since the best turning point. Gaussian with ``variance``, else Poisson."""

    def statistic(s: Column, n: Column) -> Column:
        if variance is not None:
            return F.pow(s - n * mean, F.lit(2.0)) / n / (2 * variance)
        grown = F.when(s > 0, F.ln(s / n) * s).otherwise(0.0)
        return grown - F.ln(F.lit(mean)) * s + n * mean - s

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("at"))

    def step(acc: Column, v: Column) -> Column:
        s, n = acc["s"] + v, acc["n"] + 1
        f = statistic(s, n)
        return F.struct(s.alias("s"), n.alias("n"), F.greatest(acc["best"], f).alias("best"), F.when(f > acc["best"], n - 1).otherwise(acc["at"]).alias("at"))

    def fold(rows: DataFrame, w: Callable[[], WindowSpec], _: str) -> DataFrame:
        values = F.reverse(F.collect_list(x.cast("double")).over(w().rowsBetween(-(size - 1), 0)))
        return rows.withColumn("__g", F.aggregate(values, zero, step))

    folded = blocks.in_blocks(df, by, order, size - 1, 0, fold)
    return folded.withColumns({"glr": F.when(F.col("__g.n") > 0, F.col("__g.best")), "glr_back": F.col("__g.at").cast("int")}).drop("__g")


def z_value(x: Column, mean: Column, variance: Column) -> Column:
    return F.try_divide(x - mean, F.sqrt(variance))


def chi_square(observed: DataFrame, expected: DataFrame, sample: float | None = None, interest: Sequence[str] | None = None) -> DataFrame:
    """One row: chi_square, ndf. Both frames are (bin, count); both are normalised. ``sample`` marks the expected counts as normalised by that sample."""
    o = observed.groupBy("bin").agg(F.sum("count").cast("double").alias("o"))
    e = expected.groupBy("bin").agg(F.sum("count").cast("double").alias("e"))
    all_bins = W.partitionBy(F.lit(0))
    both = o.join(e, "bin", "full").na.fill(0.0, ["o", "e"]).withColumns({"ot": F.sum("o").over(all_bins), "et": F.sum("e").over(all_bins)})
    if interest is not None:
        both = both.where(F.col("bin").isin(list(interest)))
    spread = F.col("o") / F.pow("ot", F.lit(2.0)) + (F.col("e") / F.pow("et", F.lit(2.0)) if sample is None else F.col("e") / F.col("et") / sample)
    used = both.where((F.col("o") > 0) | (F.col("e") > 0))
    term = F.pow(F.col("e") / F.col("et") - F.col("o") / F.col("ot"), F.lit(2.0)) / spread
    return used.agg(F.sum(term).alias("chi_square"), (F.count(F.lit(1)) - (1 if interest is None else 0)).alias("ndf"))


def scalar_product(observed: DataFrame, expected: DataFrame, scheme: str | None = None) -> DataFrame:
    """One row: dot product of the counts; ``Independent`` is the cosine, ``SizeWeighted`` 2·dot / (n₁ + n₂)."""
    o = observed.groupBy("bin").agg(F.sum("count").cast("double").alias("o"))
    e = expected.groupBy("bin").agg(F.sum("count").cast("double").alias("e"))
    s = o.join(e, "bin", "full").na.fill(0.0, ["o", "e"]).agg(F.sum(F.col("o") * F.col("e")).alias("d"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("e") * F.col("e")).alias("ee"))
    value = {None: F.col("d"), "Independent": F.try_divide(F.col("d"), F.sqrt(F.col("oo") * F.col("ee"))), "SizeWeighted": F.try_divide(2 * F.col("d"), F.col("oo") + F.col("ee"))}[scheme]
    return s.select(F.when((F.col("oo") > 0) & (F.col("ee") > 0), value).alias("score"))


def chi_square_independence(df: DataFrame, *fields: str) -> DataFrame:
    """Contingency of two or more fields against the product of their margins; ndf = Π(levels - 1). Rows with a null are skipped.

    Over all cells Σ(n - E)²/E = Σ n²/E - N, and empty cells add nothing to the right side: no grid of levels is built.
    """
    kept = df.where(reduce(lambda p, q: p & q, [F.col(f).isNotNull() for f in fields]))
    cells = kept.groupBy(*fields).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("t")).first()["t"]
    if not total:
        return df.sparkSession.createDataFrame([], "chi_square double, ndf long")
    expected = F.lit(float(total))
    for i, f in enumerate(fields):
        margin = cells.groupBy(F.col(f).alias(f"__f{i}")).agg(F.sum("n").alias(f"__m{i}"))
        cells = cells.join(margin, F.col(f) == F.col(f"__f{i}")).drop(f"__f{i}")
        expected = expected * (F.col(f"__m{i}") / float(total))
    levels = reduce(lambda p, q: p * q, [F.countDistinct(f) - 1 for f in fields])
    return cells.agg((F.sum(F.col("n") * F.col("n") / expected) - float(total)).alias("chi_square"), levels.alias("ndf"))


def distance_by_condition(observed: DataFrame, expected: DataFrame, condition: str, bin_col: str, weight: str | None = None, scheme: str | None = None) -> DataFrame:
    """(condition, score, top_bin, top_part): the scalar product of each condition's counts with the expected ones of that condition.

    Both have the condition and the bin; ``expected`` has ``count`` too. ``scheme`` as for scalar_product. The bin that adds
    most comes with its part; of equal parts the largest bin. A condition on one side only has no score.
    """
    o = observed.groupBy(condition, bin_col).agg((F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight).cast("double")).alias("o"))
    e = expected.groupBy(condition, bin_col).agg(F.sum("count").cast("double").alias("e"))
    both = o.join(e, [condition, bin_col], "full").na.fill(0.0, ["o", "e"]).where(F.col(condition).isNotNull())
    part = F.col("o") * F.col("e")
    s = both.groupBy(condition).agg(F.sum(part).alias("d"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.max(F.struct(part.alias("p"), F.col(bin_col).alias("b"))).alias("top"))
    value = {None: F.col("d"), "Independent": F.try_divide(F.col("d"), F.sqrt(F.col("oo") * F.col("ee"))), "SizeWeighted": F.try_divide(2 * F.col("d"), F.col("oo") + F.col("ee"))}[scheme]
    return s.where("oo > 0 and ee > 0").select(condition, value.alias("score"), F.col("top.b").alias("top_bin"), F.col("top.p").alias("top_part"))


def windowed_distance(df: DataFrame, bin_col: str, expected: DataFrame, size: int, by: Sequence[str], order: Sequence[str], out: str, scheme: str | None = None) -> DataFrame:
    """Scalar product of the counts of the last ``size`` rows with expected counts (bin, count), row by row."""
    e = expected.groupBy("bin").agg(F.sum("count").cast("double").alias("__e"))
    squares = e.agg(F.sum(F.col("__e") * F.col("__e")).alias("s")).first()["s"] or 0.0
    joined = df.join(e, F.col(bin_col) == F.col("bin"), "left").drop("bin")

    def run(rows: DataFrame, w: Callable[[], WindowSpec], _: str) -> DataFrame:
        frame = w().rowsBetween(-(size - 1), 0)
        seen = F.collect_list(bin_col).over(frame)
        oo = F.aggregate(F.array_distinct(seen), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(seen, lambda x: x == v)).cast("double"), F.lit(2.0)))
        dot = F.coalesce(F.sum("__e").over(frame), F.lit(0.0))
        if scheme is None:
            return rows.withColumn(out, dot)
        rows = rows.withColumns({"__d": dot, "__oo": oo})
        value = F.try_divide(F.col("__d"), F.sqrt(F.col("__oo") * squares)) if scheme == "Independent" else F.try_divide(2 * F.col("__d"), F.col("__oo") + squares)
        return rows.withColumn(out, value).drop("__d", "__oo")

    return blocks.in_blocks(joined, by, order, size - 1, 0, run).drop("__e")
