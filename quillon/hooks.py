"""User code around the plans: functions of the language, hooks over batches, and an engine to embed.

Functions of columns stay in the JVM; functions of Python values run on Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import masked, plain
from quillon.mcol import propagate
from quillon.plans import models
from quillon.plans.ir import Node


def register(name: str, fn: Callable[..., Column], model: bool = True, table: bool = True) -> None:
    """Adds a function of columns to the model language (masks propagate), to the table language, or both. Names that exist raise."""
    if (model and name in masked.TABLE) or (table and name in plain.TABLE):
        raise ValueError(f"function {name!r} exists")
    if model:
        built = lambda a: propagate(fn(*(x.value for x in a)), a)
        masked.TABLE[name] = masked.LEGACY[name] = built
    if table:
        plain.TABLE[name] = fn


def unregister(name: str) -> None:
    for known in (masked.TABLE, masked.LEGACY, plain.TABLE):
        known.pop(name, None)


def vectorised(fn: Callable, returns: str = "double", elementwise: bool = True) -> Callable[..., Column]:
    """A function of columns from one of Python values, run batch by batch; null arguments give null.

    With ``elementwise`` false ``fn`` takes and returns whole pandas series.
    """

    def run(*args: pd.Series) -> pd.Series:
        if not elementwise:
            return fn(*args)
        ok = ~pd.concat([a.isna() for a in args], axis=1).any(axis=1)
        out = pd.Series([None] * len(args[0]), dtype=object)
        out[ok] = [fn(*v) for v in zip(*(a[ok] for a in args), strict=True)]
        return out

    udf = F.pandas_udf(run, returns, F.PandasUDFType.SCALAR)
    return lambda *columns: udf(*columns)


class Hooks:
    """Custom processing of a partition: override what is needed.

    ``begin`` is called once a partition, ``event`` with each Arrow batch, ``end`` at its end; ``exception`` gets
    what ``event`` raised and either returns rows instead or raises. ``self`` holds state of one partition only, and
    an executor that is lost runs its partitions again from their begin.
    """

    def begin(self) -> None:
        pass

    def event(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        return rows

    def exception(self, error: Exception, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise error

    def end(self) -> pd.DataFrame | None:
        return None


def process(df: DataFrame, hooks: Callable[[], Hooks], schema: str) -> DataFrame:
    """Runs hooks, made anew for each partition, over all rows. None gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = hooks()
        mine.begin()
        for frame in frames:
            try:
                made = mine.event(frame)
            except Exception as error:
                made = mine.exception(error, frame)
            if made is not None:
                yield made
        made = mine.end()
        if made is not None:
            yield made

    return df.mapInPandas(run, schema)


class Engine:
    """A model to embed: events go in as mappings, scores come back as mappings.

    Events of one call form one small frame, so a call costs a job; tables go through ``frame``.
    """

    def __init__(self, spark: SparkSession, doc: Node, schema: str, features: Sequence[str] = ()) -> None:
        self.spark, self.doc, self.schema, self.features = spark, doc, schema, tuple(features)

    def frame(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return models.score(df, self.doc, tuple(keep), self.features)

    def events(self, events: Sequence[Mapping]) -> list[dict]:
        """Scores in the order of the events; fields that are absent are null."""
        if not events:
            return []
        lines = self.spark.createDataFrame([(i, json.dumps(dict(e), default=str)) for i, e in enumerate(events)], "event_no long, line string")
        rows = lines.select("event_no", F.from_json("line", self.schema).alias("e")).select("event_no", "e.*")
        scored = models.score(rows, self.doc, ("event_no",), self.features).orderBy("event_no").collect()
        return [{k: v for k, v in r.asDict().items() if k != "event_no"} for r in scored]

    def event(self, event: Mapping) -> dict:
        return self.events([event])[0]


__all__ = ["Engine", "Hooks", "process", "register", "unregister", "vectorised"]
