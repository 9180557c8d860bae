"""Rolling totals over trailing periods, days without activity included.

Rows are reduced to daily totals first, so a hot entity shrinks to one row a day before any join. Each
date of an entity's calendar is joined to the totals within its trailing bound; coarse date buckets make
that range join an equi-join on (entity, bucket) with at most two buckets a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: Column, day: Column, amount: Column, row_id: Column | None = None, arrived: Column | None = None) -> DataFrame:
    """(entity, day, total, n_amounts, n_rows). A row id counts once, in its first delivery.

    Rows with a null entity or day are left out; null amounts add nothing but keep their day.
    """
    rows = df.select(entity.alias("entity"), day.alias("day"), amount.cast("long").alias("amount"), *([row_id.alias("rid"), arrived.alias("arrived")] if row_id is not None else []))
    if row_id is not None:
        first = F.min(F.struct("arrived", "day", "entity", "amount")).alias("first")
        keyed = rows.filter(F.col("rid").isNotNull()).groupBy("rid").agg(first).select("first.*")
        loose = rows.filter(F.col("rid").isNull()).select("arrived", "day", "entity", "amount")
        rows = keyed.unionByName(loose)
    rows = rows.filter(F.col("entity").isNotNull() & F.col("day").isNotNull())
    return rows.groupBy("entity", "day").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"), F.count("amount").alias("n_amounts"), F.count(F.lit(1)).alias("n_rows"))


def trailing(daily: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For every entity and each day from its first to its last: totals and averages of the trailing periods.

    Output: entity, day, day_no (from 1), day_total, and for each period p total_p, amounts_p (number of
    amounts), mean_p (total by amount, null without amounts) and per_day_p (total / p). Days before the
    entity's first count as empty.
    """
    longest = max(periods)
    span = daily.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    calendar = span.select("entity", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    number = F.unix_date("day")
    calendar = calendar.withColumn("d", number).withColumn(
        "bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("d") - longest + 1) / longest), F.floor(F.col("d") / longest))))
    )
    totals = daily.select(F.col("entity").alias("e2"), F.unix_date("day").alias("d2"), F.floor(F.unix_date("day") / longest).alias("b2"), "total", "n_amounts")
    joined = calendar.join(totals, (F.col("entity") == F.col("e2")) & (F.col("bucket") == F.col("b2")) & (F.col("d2") <= F.col("d")) & (F.col("d2") > F.col("d") - longest), "left")
    aggs = [F.coalesce(F.sum(F.when(F.col("d2") == F.col("d"), F.col("total"))), F.lit(0)).alias("day_total")]
    for p in periods:
        near = F.col("d2") > F.col("d") - p
        aggs += [F.coalesce(F.sum(F.when(near, F.col("total"))), F.lit(0)).alias(f"total_{p}"), F.coalesce(F.sum(F.when(near, F.col("n_amounts"))), F.lit(0)).alias(f"amounts_{p}")]
    out = joined.groupBy("entity", "day", "first_day").agg(*aggs)
    cols = [c for p in periods for c in (F.col(f"total_{p}"), F.col(f"amounts_{p}"), F.try_divide(F.col(f"total_{p}").cast("double"), F.col(f"amounts_{p}")).alias(f"mean_{p}"), (F.col(f"total_{p}") / F.lit(float(p))).alias(f"per_day_{p}"))]
    return out.select("entity", "day", (F.datediff("day", "first_day") + 1).alias("day_no"), "day_total", *cols)


def remarkable_days(rolled: DataFrame, short: int = 7, long: int = 30, factor: int = 2) -> DataFrame:
    """``quiet`` and ``surge`` days, from the ``long``-th day of each entity on. Whole-number comparison, so ties are exact."""
    s, m = F.col(f"total_{short}"), F.col(f"total_{long}")
    kind = F.when((s == 0) & (m != 0), "quiet").when(s * long > m * short * factor, "surge")
    return rolled.filter(F.col("day_no") >= long).select("entity", "day", kind.alias("day_kind")).filter("day_kind is not null")
