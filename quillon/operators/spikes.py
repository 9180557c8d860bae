"""Implausible readings: impossible values, stuck runs and short spikes, judged per source.

Each source's readings are numbered in time order by a two-step prefix sum (rows within a day, then day
offsets), cut into blocks of equal length with a halo on both sides, and filtered block by block, so a
source with a third of all rows spreads over many tasks. A local-level Kalman filter runs over each block:
the observation variance grows with the level by the source's own coefficient, readings whose standardised
innovation passes the gate are flagged and their update withheld. A backward pass smooths the level, and a
flagged reading is a spike if its innovation against the smoothed level, which flagged readings never moved,
reaches ten times the usual scatter. Stuck runs are those over which the innovation variance vanishes: a source
that repeats itself has no observation noise, so the filter follows it with a gain of one and its innovations
are the steps from reading to reading.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise

FAULTS = "reading_id long, fault string, score double"


def first_deliveries(df: DataFrame, id_col: str, arrival: str, cols: dict[str, Column]) -> DataFrame:
    """One row an id, the earliest delivery; rows without an id are dropped."""
    picked = df.select(F.col(id_col).alias("reading_id"), F.col(arrival).alias("arrival"), *[c.alias(n) for n, c in cols.items()])
    picked = picked.filter("reading_id is not null")
    return picked.groupBy("reading_id").agg(F.min(F.struct("arrival", *cols)).alias("f")).select("reading_id", *[F.col(f"f.{n}").alias(n) for n in cols])


def numbered(readings: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each reading in its source's order, and ``coef``, the source's usual scatter.

    ``coef`` is 1.4826 times the median of |volume - mean of both neighbours| / sqrt(1.5 × level) over all
    sound readings of the source: a steady rise or fall of the level cancels in it.
    """
    day = F.floor(F.unix_micros("at") / 86_400_000_000)
    order = W.partitionBy("source", "day").orderBy("at", "reading_id")
    rows = readings.withColumn("day", day).withColumn("nth", F.row_number().over(order)).withColumn("level", (F.lag("volume").over(order) + F.lead("volume").over(order)) / 2)
    rows = materialise(rows, "readings")
    sound = F.col("volume").between(F.lit(0), F.coalesce("most", F.lit(2**62)))
    z = F.when(sound, F.abs(F.col("volume") - F.col("level")) / F.sqrt(1.5 * F.greatest("level", F.lit(1.0))))
    coef = rows.groupBy("source").agg((F.percentile_approx(z, 0.5, 1000) * 1.4826).alias("coef"))
    upto = W.partitionBy("source").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("source", "day").count().withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    days = days.join(coef, "source").select("source", "day", "before", "coef")
    return rows.join(days, ["source", "day"]).withColumn("pos", F.col("before") + F.col("nth") - 1).drop("before", "nth", "day", "level")


def still(v: np.ndarray, run: int) -> np.ndarray:
    """Which entries lie in ``run`` or more successive ones over which the variance of the innovations is nil."""
    out = np.zeros(len(v), bool)
    if len(v) < run:
        return out
    innovation = np.diff(v).astype(float)
    # A window of innovations that are all nil has mean square nil; the sums of zeros and ones are exact.
    moved = np.r_[0, np.cumsum(innovation != 0)]
    calm = np.flatnonzero(moved[run - 1 :] == moved[: len(moved) - run + 1])
    edge = np.zeros(len(v) + 1, int)
    np.add.at(edge, calm, 1)
    np.add.at(edge, calm + run, -1)
    return np.cumsum(edge[:-1]) > 0


def smoothed(v: np.ndarray, coef: float, gate: float = 5.0, drift: float = 0.25, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Flags, and the smoothed level, of a local-level filter that withholds flagged updates.

    The state is the traffic level with variance ``p``; the observation variance is coef² × level. More
    than ``longest`` flagged readings in a row are a new level: the filter starts anew from them, only those
    far off the new level stay flagged, and nothing is smoothed across that break.
    """
    n = len(v)
    flags = np.zeros(n, bool)
    if not n:
        return flags, np.zeros(0)
    values, levels, spread, ahead = v.tolist(), [0.0] * n, [0.0] * n, [0.0] * n
    level, c2, out = float(np.median(v[:5])), coef * coef, 0
    p = c2 * max(level, 1.0)
    for i in range(n):
        r = c2 * max(level, 1.0)
        p += drift * r
        ahead[i] = p
        e, s = values[i] - level, p + r
        if e * e <= gate * gate * s:
            k = p / s
            level += k * e
            p *= 1 - k
            out = 0
        else:
            flags[i] = True
            out += 1
            if out > longest:
                last = v[i - out + 1 : i + 1]
                level = float(np.median(last))
                p = c2 * max(level, 1.0)
                # A spike at the foot of a steep rise stays one: each is seen anew from the new level.
                flags[i - out + 1 : i + 1] = (last - level) ** 2 > gate * gate * 2 * p
                for j in range(i - out + 1, i + 1):
                    levels[j], spread[j], ahead[j] = level, p, p
                ahead[i - out + 1] = float("inf")
                out = 0
        levels[i], spread[i] = level, p
    for i in range(n - 2, -1, -1):
        levels[i] += spread[i] / ahead[i + 1] * (levels[i + 1] - levels[i])
    return flags, np.array(levels)


def judge(frame: pd.DataFrame, run: int = 8, times: float = 10.0, longest: int = 3, floor: float = 0.5) -> pd.DataFrame:
    """Faults of one block, its halo included in the input but not in the output."""
    frame = frame.sort_values("pos")
    v = frame["volume"].to_numpy(dtype=np.int64)
    most = frame["most"].to_numpy(dtype=float)
    impossible = (v < 0) | (v > np.where(np.isnan(most), np.inf, most))
    stuck = still(v, run) & ~impossible
    c = frame["coef"].iloc[0]
    # The floor stands in only for a source that hardly ever moves off its neighbours.
    coef = (float(c) if c > 0 else floor) if c is not None and c == c else 1.0
    sound = np.flatnonzero(~impossible & ~stuck)
    x = v[sound].astype(float)
    flags, level = smoothed(x, coef, longest=longest)
    score = (x - level) / (coef * np.sqrt(np.maximum(level, 1.0)))
    spike, scores = np.zeros(len(v), bool), np.zeros(len(v))
    spike[sound], scores[sound] = flags & (np.abs(score) >= times), score
    fault = np.where(impossible, "impossible", np.where(stuck, "stuck", np.where(spike, "spike", "")))
    out = pd.DataFrame({"reading_id": frame["reading_id"].to_numpy(), "fault": fault.astype(object), "score": scores})
    return out[(fault != "") & frame["core"].to_numpy()]


def faulty_readings(df: DataFrame, block: int = 4096, halo: int = 96, times: float = 10.0, run: int = 8, longest: int = 3) -> DataFrame:
    """(reading_id, fault, score) of test_data-shaped readings.

    Sources are trimmed, case ignored; a null sensor counts as one source of its own. Null volumes, null
    ids and null read_at are left out. Null lanes or period_s leave only values below 0 impossible. Ties
    in time are ordered by reading_id. ``halo`` readings from both neighbours warm up each block; it must
    be at least ``run``.
    """
    source = F.coalesce(F.lower(F.regexp_replace("sensor", r"^\s+|\s+$", "")), F.lit(""))
    most = (F.col("lanes").cast("double") * F.col("period_s"))
    cols = {"source": source, "at": F.col("read_at").cast("timestamp"), "volume": F.col("volume").cast("long"), "most": most}
    readings = first_deliveries(df, "reading_id", "arrived_at", cols).filter("volume is not null and at is not null")
    rows = numbered(readings)
    here, offset = F.floor(F.col("pos") / block), F.col("pos") % block
    copies = F.array_compact(F.array(F.struct(here.alias("block"), F.lit(True).alias("core")), F.when(offset < halo, F.struct((here - 1).alias("block"), F.lit(False).alias("core"))), F.when(offset >= block - halo, F.struct((here + 1).alias("block"), F.lit(False).alias("core")))))
    spread = rows.select("source", "pos", "reading_id", "volume", "most", "coef", F.explode(copies).alias("c")).select("*", "c.block", "c.core").drop("c")
    return spread.groupBy("source", "block").applyInPandas(lambda frame: judge(frame, run=run, times=times, longest=longest), FAULTS)
