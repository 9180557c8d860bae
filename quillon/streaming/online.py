"""Streaming operators: pseudo-event windows and per-key online learning with explicit state.

Batches and streams share the plans of the other modules; what is here needs state between micro-batches.
"""

from __future__ import annotations

import math
import time as clock
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import blocks
from quillon.plans import models
from quillon.plans.ir import Node


def pseudo_events(stream: DataFrame, time: str, every: str, x: str, by: tuple[str, ...] = (), late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Aggregates emitted and flushed at each interval of a time field: count, sum, mean, low, high.

    ``late`` is the watermark: rows later than that are dropped by a stream, and state older is removed.
    """
    window = F.window(time, every, slide) if slide else F.window(time, every)
    aggs = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
    return aggs.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "mean", "low", "high")


def counted_pseudo_events(df: DataFrame, n: int, order: tuple[str, ...], by: tuple[str, ...], x: str) -> DataFrame:
    """Aggregates of every n rows of a key in order; the last batch may be shorter."""
    return blocks.numbered(df, by, order, "__nth").withColumn("batch_no", F.floor(F.col("__nth") / n)).groupBy(*by, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"))


def online_z_values(stream: DataFrame, key: str, order: str, x: str, mature: int = 5, timeout: str = "no") -> DataFrame:
    """(key, order, z, n): each row is scored by the running moments of its key's earlier rows, then learnt.

    Moments are kept by Welford's recurrence. Keys with fewer than ``mature`` rows, or no variance, give a
    null score; null x is neither scored nor learnt. Rows of one micro-batch are taken in ``order``. With
    ``timeout="processing"`` the state of keys idle for an hour is dropped.
    """
    kinds = dict(stream.dtypes)
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, z double, n long"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        made = []
        for at, v in zip(rows[order], rows[x].astype(float), strict=True):
            z = None
            if not math.isnan(v):
                if n >= mature and n >= 2 and m2 > 0:
                    z = (v - mean) / math.sqrt(m2 / (n - 1))
                n += 1
                step = v - mean
                mean += step / n
                m2 += step * (v - mean)
            made.append((k[0], at, z, n))
        state.update((n, mean, m2))
        if timeout == "processing":
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(made, columns=[key, order, "z", "n"]).astype({"z": "Float64"})

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout == "processing" else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out, "n long, mean double, m2 double", "append", kind)


def score_stream(stream: DataFrame, doc: Node, sink: Callable[[DataFrame, int], None], keep: tuple[str, ...], checkpoint: str, once: bool = True):
    """Scores each micro-batch with a compiled model and hands it to ``sink``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(models.score(batch, doc, keep), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(frame: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a parquet table and reads it back."""
    query = frame.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/data")


def completed(frame: DataFrame, path: str) -> DataFrame:
    """The last whole result of an aggregating stream over all that is there now; tasks write it, the driver holds none of it."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data")

    frame.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/data")


def learn_stream(stream: DataFrame, x: str, by: tuple[str, ...], state_path: str, write: Callable[[DataFrame, int], None], every: int, checkpoint: str, every_seconds: float | None = None):
    """Online training: moments of each segment are merged batch by batch and handed to ``write`` each time
    ``every`` more rows are known, and at the end of a batch that finishes the input.

    ``by`` names at least one column. The state is a table of (segment, n, mean, m2), one version a batch, so a batch that is run again
    starts from the version before it. With ``every_seconds`` the model is also handed out when that long has passed since it last was.
    """
    spark = stream.sparkSession
    last = [clock.monotonic()]

    def each(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))
        if number:
            old = spark.read.parquet(f"{state_path}/v{number - 1}").select(*by, *[F.col(c).alias(f"o_{c}") for c in ("n", "mean", "m2")])
            both = new.join(old, list(by), "full").na.fill(0, ["n", "o_n"]).na.fill(0.0, ["mean", "m2", "o_mean", "o_m2"])
            total, gap = F.col("n") + F.col("o_n"), F.col("mean") - F.col("o_mean")
            new = both.select(*by, total.alias("n"), (F.col("o_mean") + gap * F.col("n") / total).alias("mean"), (F.col("m2") + F.col("o_m2") + gap * gap * F.col("n") * F.col("o_n") / total).alias("m2"))
        new.write.mode("overwrite").parquet(f"{state_path}/v{number}")
        now = spark.read.parquet(f"{state_path}/v{number}")
        rows = now.agg(F.sum("n").alias("n")).first()["n"] or 0
        before = (spark.read.parquet(f"{state_path}/v{number - 1}").agg(F.sum("n").alias("n")).first()["n"] or 0) if number else 0
        due = every_seconds is not None and clock.monotonic() - last[0] >= every_seconds
        if rows // every > before // every or due:
            last[0] = clock.monotonic()
            write(now.withColumn("variance", F.when(F.col("n") >= 2, F.col("m2") / (F.col("n") - 1))), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
