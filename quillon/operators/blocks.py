"""Order-dependent work on keys of any size: rows are cut into pieces by key and order, not by key alone.

``placed`` range-partitions the rows by key and order, so a key with most of the rows spreads over many
pieces; within a piece each key's rows are one segment. What a segment needs from those before it is folded from
one summary row a segment. Only a key that crosses from one piece to the next has a segment that is not its
first, so that what is sent to all tasks has fewer rows than there are pieces.

Pieces cost a sampling pass and a written table. They are made where a count by key finds one of more than
``HOT_ROWS`` rows; else each key is one segment, in one ordinary window. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise

PIECE = "__p"
#: Rows of one key that one task may sort.
HOT_ROWS = 4_000_000
#: The type of PIECE where each key is one segment.
_WHOLE = "tinyint"


def hot(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether a key holds more than HOT_ROWS rows: partial counts, one row back."""
    most = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] if by else df.count()
    return (most or 0) > HOT_ROWS


def _whole(rows: DataFrame) -> bool:
    return dict(rows.dtypes)[PIECE] == _WHOLE


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], pieces: int | None) -> DataFrame:
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by, *order)


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """The rows with their piece. Written once: the bounds are drawn from the data and must not be drawn twice.

    With ``pieces`` given they are always made.
    """
    if pieces is None and not hot(df, by):
        return df.withColumn(PIECE, F.lit(0).cast(_WHOLE))
    return materialise(_ranged(df, by, order, pieces).withColumn(PIECE, F.spark_partition_id()), "pieces")


def local(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a segment up to the present one."""
    return W.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def earlier(by: Sequence[str]) -> WindowSpec:
    """The segments of a key before the present one, over summary rows."""
    return W.partitionBy(*by).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)


def with_carry(rows: DataFrame, by: Sequence[str], summary: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Adds the carried columns, null in a key's first segment.

    ``summary`` are aggregates of a segment, ``carry`` columns over the earlier segments' summaries.
    """
    segments = rows.groupBy(*by, PIECE).agg(*[c.alias(n) for n, c in summary.items()])
    found = segments
    for n, c in carry(earlier(by)).items():
        found = found.withColumn(n, c)
    names = [n for n in found.columns if n not in (*by, PIECE, *summary)]
    if _whole(rows):
        return rows.withColumns({n: F.lit(None).cast(found.schema[n].dataType) for n in names})
    nth = F.row_number().over(W.partitionBy(*by).orderBy(PIECE))
    found = found.withColumn("__nth", nth).where("__nth > 1").select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], F.col(PIECE).alias("__kp"), *names)
    on = F.col(PIECE) == F.col("__kp")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    # Fewer rows than pieces.
    return rows.join(F.broadcast(found), on, "left").drop("__kp", *[f"__k{i}" for i in range(len(by))])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, pieces: int | None = None) -> DataFrame:
    """Each row's place within its key, from 0."""
    rows = placed(df, by, order, pieces if by else pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn(out, F.row_number().over(W.partitionBy(*by, PIECE).orderBy(*order)) - 1)
    rows = with_carry(rows, by, {"__n": F.count(F.lit(1))}, lambda w: {"__before": F.sum("__n").over(w)})
    return rows.withColumn(out, F.col(out) + F.coalesce("__before", F.lit(0))).drop("__before", PIECE)


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, run: Callable[[DataFrame, Callable[[], WindowSpec], str], DataFrame], block: int = 65_536) -> DataFrame:
    """Runs window work that looks at most ``before`` rows back and ``after`` ahead, block by block of a key.

    Each block gets copies of its neighbours' nearest rows, which are dropped again. ``run`` takes the rows,
    a function for the ordered window of a block, and the name of the row's place in its key.
    """
    block = max(block, before, after, 1)
    if not hot(df, by):
        rows = df.withColumns({"__pos": F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1, "__b": F.lit(0).cast("bigint"), "__core": F.lit(True)})
        return run(rows, lambda: W.partitionBy(*by, "__b").orderBy(*order), "__pos").drop("__b", "__core", "__pos")
    rows = numbered(df, by, order, "__pos")
    here, offset = F.floor(F.col("__pos") / block), F.col("__pos") % block
    copies = [F.struct(here.alias("b"), F.lit(True).alias("core"))]
    if after:
        copies.append(F.when((offset < after) & (here > 0), F.struct((here - 1).alias("b"), F.lit(False).alias("core"))))
    if before:
        copies.append(F.when(offset >= block - before, F.struct((here + 1).alias("b"), F.lit(False).alias("core"))))
    rows = rows.withColumn("__c", F.explode(F.array_compact(F.array(*copies)))).withColumns({"__b": F.col("__c.b"), "__core": F.col("__c.core")}).drop("__c")
    done = run(rows, lambda: W.partitionBy(*by, "__b").orderBy("__pos"), "__pos")
    return done.where("__core").drop("__b", "__core", "__pos")


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], schema: str, step: Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]], pieces: int | None = None) -> DataFrame:
    """Rows with columns that a recurrence makes, started anew in each segment; written once, with their piece.

    ``step`` takes the next rows of one segment and its state ({} at its start) and gives the new columns and state.
    ``schema`` names the new columns. Batches of a piece come in order, so no segment is held as a whole.
    """
    split = not by or pieces is not None or hot(df, by)
    ranged = _ranged(df, by, order, pieces) if split else df.repartition(*by)
    ranged = ranged.sortWithinPartitions(*by, *order).withColumn(PIECE, F.spark_partition_id() if split else F.lit(0).cast(_WHOLE))
    keys = list(by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = {}, None
        for frame in frames:
            if not len(frame):
                continue
            same = np.ones(len(frame), bool)
            for k in keys:
                now, was = frame[k], frame[k].shift()
                same &= ((now == was) | (now.isna() & was.isna())).to_numpy(dtype=bool)
            starts = np.unique(np.r_[0, np.flatnonzero(~same)])
            done = []
            for a, b in zip(starts, np.r_[starts[1:], len(frame)], strict=True):
                part = frame.iloc[a:b]
                key = tuple(None if pd.isna(part[k].iloc[0]) else part[k].iloc[0] for k in keys)
                if key != last:
                    state, last = {}, key
                made, state = step(part, state)
                done.append(made)
            yield pd.concat([frame.reset_index(drop=True), pd.concat(done, ignore_index=True)], axis=1)

    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    made = ranged.mapInPandas(run, f"{text}, {schema}")
    return materialise(made, "scanned") if split else made


def percentiles(df: DataFrame, by: Sequence[str], y: str, levels: Sequence[float], out: str = "levels") -> DataFrame:
    """(keys, levels): exact, interpolated percentiles from running counts of distinct values; no task holds all values of a key.

    Null y counts for nothing; a key without a value gives no row.
    """
    counts = df.where(F.col(y).isNotNull()).groupBy(*by, F.col(y).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    rows = placed(counts, by, ["__y"]).withColumn("__upto", F.sum("__n").over(local(by, ["__y"])))
    rows = with_carry(rows, by, {"__t": F.sum("__n")}, lambda w: {"__before": F.sum("__t").over(w)})
    rows = rows.withColumn("__upto", F.col("__upto") + F.coalesce("__before", F.lit(0))).drop("__before", PIECE)
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    on = F.lit(True)
    for i, b in enumerate(by):
        totals = totals.withColumnRenamed(b, f"__k{i}")
        on = on & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    both = rows.join(totals, on) if by else rows.crossJoin(F.broadcast(totals))  # Without keys: one row of totals.
    picks = []
    for k, v in enumerate(levels):
        at = (F.col("__all") - 1) * float(v)
        for side, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col("__y"))).alias(f"__{side}{k}"))
    found = both.groupBy(*by).agg(*picks, F.max("__all").alias("__all"))
    made = []
    for k, v in enumerate(levels):
        at = (F.col("__all") - 1) * float(v)
        made.append(F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (at - F.floor(at)))
    return found.where("__all > 0").select(*by, F.array(*made).alias(out))
