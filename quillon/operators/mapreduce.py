"""Map and reduce steps of the user's own, over Arrow batches, with iteration.

A mapper turns a batch into keyed rows; a combiner, where the reduction allows one, shrinks each batch
before the shuffle; a reducer sees all rows of a key. Keys that may be hot need a combiner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Frames = Callable[[pd.DataFrame], pd.DataFrame]


def map_reduce(df: DataFrame, mapper: Frames, mapped: str, reducer: Frames, reduced: str, key: str, combiner: Frames | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Rows of ``reduced`` schema. ``sort`` orders a key's rows before the reducer sees them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = mapper(frame)
            if combiner is not None and len(out):
                out = pd.concat([combiner(g) for _, g in out.groupby(key, dropna=False)])
            yield out

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        return reducer(frame.sort_values(list(sort), kind="stable") if sort else frame)

    return df.mapInPandas(run, mapped).groupBy(key).applyInPandas(fold, reduced)


def iterate(step: Callable[[object], object], start: object, done: Callable[[object, object], bool], most: int) -> tuple[object, int]:
    """Runs ``step`` until ``done(before, after)`` or ``most`` rounds; returns the last state and the number of rounds."""
    now = start
    for n in range(1, most + 1):
        after = step(now)
        if done(now, after):
            return after, n
        now = after
    return now, most
