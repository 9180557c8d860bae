"""Table verbs: projection and cuts, slices, order, expansion, comparison, histograms and plot data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import formula
from quillon.operators import blocks


def evaluate(df: DataFrame, expressions: str, names: Sequence[str]) -> DataFrame:
    """Projection of a comma list of formulas."""
    nodes = formula.parse_list(expressions)
    return df.select(*[formula.compile_plain(n).alias(a) for n, a in zip(nodes, names, strict=True)])


def select(df: DataFrame, expressions: str, names: Sequence[str], cuts: str | None = None, most: int | None = None) -> DataFrame:
    """Projection with cuts, a comma list that is ANDed; ``most`` stops early."""
    if cuts:
        df = df.where(reduce(lambda a, b: a & b, [formula.compile_plain(n) for n in formula.parse_list(cuts)]))
    out = evaluate(df, expressions, names)
    return out.limit(most) if most is not None else out


def apply_rules(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Named rules, in any order: each formula may use the columns and the other rules; circles raise."""
    left = {n: formula.parse(t) for n, t in rules.items()}
    while left:
        ready = {n: t for n, t in left.items() if not formula.fields(t) & (set(left) - {n}) and n not in formula.fields(t) - set(df.columns)}
        if not ready:
            raise formula.FormulaError(f"rules in a circle: {', '.join(sorted(left))}")
        df = df.withColumns({n: formula.compile_plain(t) for n, t in ready.items()})
        left = {n: t for n, t in left.items() if n not in ready}
    return df


def add_index(df: DataFrame, order: Sequence[str], out: str = "row_no", pieces: int | None = None) -> DataFrame:
    """Numbers all rows from 0 in order: counts of range partitions give offsets, so no task sees all rows."""
    return blocks.numbered(df, [], order, out, pieces).withColumn(out, F.col(out).cast("bigint"))


def slice_rows(df: DataFrame, order: Sequence[str], start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """Rows start, start + stride, … below stop, in order, from 0."""
    rows = add_index(df, order, "__row")
    keep = (F.col("__row") >= start) & ((F.col("__row") - start) % stride == 0)
    if stop is not None:
        keep = keep & (F.col("__row") < stop)
    return rows.where(keep).drop("__row")


def sorted_on(df: DataFrame, key: str, ties: Sequence[str], reverse: bool = False) -> DataFrame:
    """Ordered by a key; ``ties`` makes the order unique."""
    return df.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in (key, *ties)])


def take(df: DataFrame, order: Sequence[str], places: DataFrame) -> DataFrame:
    """Gathers rows by place; ``places`` has the column ``row_no`` and may repeat."""
    return add_index(df, order, "row_no").join(places.select("row_no"), "row_no").drop("row_no")


def expand(df: DataFrame, count: str) -> DataFrame:
    """Repeats each row ``count`` times and drops the count; null and counts below 1 give no row."""
    return df.where(F.col(count) > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col(count).cast("int")))).drop("__n", count)


def extend(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells that differ: key, field, left, right. A row on one side only differs in every field."""
    fields = [c for c in a.columns if c in b.columns and c not in key]
    x = a.select(*key, F.lit(True).alias("__a"), *[F.col(c).cast("string").alias(f"__x_{c}") for c in fields])
    y = b.select(*key, F.lit(True).alias("__b"), *[F.col(c).cast("string").alias(f"__y_{c}") for c in fields])
    both = x.join(y, list(key), "full")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__x_{c}").alias("left"), F.col(f"__y_{c}").alias("right")) for c in fields])
    one_sided = F.col("__a").isNull() | F.col("__b").isNull()
    return both.select(*key, F.explode(F.filter(cells, lambda s: one_sided | ~s["left"].eqNullSafe(s["right"]))).alias("c")).select(*key, "c.*")


def difference_keys(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Column names on one side only, and on both."""
    return {"left": [c for c in a.columns if c not in b.columns], "right": [c for c in b.columns if c not in a.columns], "both": [c for c in a.columns if c in b.columns]}


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repetitions counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def histogram(df: DataFrame, x: Column, bins: int, low: float | None = None, high: float | None = None, weight: Column | None = None, cuts: Column | None = None) -> DataFrame:
    """(bin, low, high, weight) of equal bins; the last is closed. Without a range, the data's own.

    Values outside the range and null are left out; empty bins are kept. One pass finds the range, one counts.
    """
    rows = (df if cuts is None else df.where(cuts)).select(x.cast("double").alias("x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    if low is None or high is None:
        found = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
        low, high = found["a"] if low is None else low, found["b"] if high is None else high
    spark = df.sparkSession
    if low is None or high is None:
        return spark.createDataFrame([], "bin int, low double, high double, weight double")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counted = rows.where(F.col("x").between(low, high)).groupBy(place.alias("bin")).agg(F.sum("w").alias("weight"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    return edges.join(counted, "bin", "left").na.fill(0.0, ["weight"])


def counts(df: DataFrame, x: str) -> DataFrame:
    """(value, count), nulls left out."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).count()


def top_by_field(df: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    """(field, value, count) of the k most frequent values of each field; ties at the cut are kept."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")).select("c.*").where("value is not null")
    totals = stacked.groupBy("field", "value").count()
    # The best of each of 64 parts of a field's values first, so that no task ranks all of them.
    part = F.pmod(F.xxhash64("value"), F.lit(64))
    best = totals.withColumn("__r", F.rank().over(W.partitionBy("field", part).orderBy(F.col("count").desc()))).where(F.col("__r") <= k)
    return best.withColumn("__r", F.rank().over(W.partitionBy("field").orderBy(F.col("count").desc()))).where(F.col("__r") <= k).drop("__r")


def sample(df: DataFrame, k: int, key: str, seed: int = 1) -> DataFrame:
    """k rows at random, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def segment_counts(df: DataFrame, segment: str, amount: str) -> DataFrame:
    """Each row with its segment's total; a null segment is one of its own. Totals are added up before they are joined."""
    totals = df.groupBy(F.col(segment).alias("__s")).agg(F.sum(amount).alias("event_count"))
    return df.drop("event_count").join(totals, F.col(segment).eqNullSafe(F.col("__s"))).drop("__s")


def match_segments(events: DataFrame, segments: DataFrame, low: str, high: str, x: str, equal: Mapping[str, str] | None = None, bucket: float = 10.0) -> DataFrame:
    """Every segment whose interval [low, high) holds x, and whose equal fields agree: an equi-join on coarse buckets of x."""
    spread = segments.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    keyed = events.withColumn("__b", F.floor(F.col(x) / bucket))
    cond = (keyed["__b"] == spread["__b"]) & (keyed[x] >= spread[low]) & (keyed[x] < spread[high])
    for e, s in (equal or {}).items():
        cond = cond & (keyed[e] == spread[s])
    return keyed.join(spread, cond).drop("__b")


def listed(df: DataFrame, names: DataFrame, key: str, black: bool) -> DataFrame:
    """Without the listed keys, or only them."""
    return df.join(names.select(key).distinct(), key, "left_anti" if black else "left_semi")


def update(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Takes the columns of ``other`` for rows of equal key: new ones are added, known ones replaced where other has the key.

    A null key matches a null key. Keys of ``other`` must be unique, or rows are repeated.
    """
    theirs = [c for c in other.columns if c not in key]
    renamed = other.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"__o_{c}") for c in theirs], F.lit(True).alias("__hit"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)])
    both = df.join(renamed, on, "left")
    kept = [F.when(F.col("__hit"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) if c in theirs else F.col(c) for c in df.columns]
    return both.select(*kept, *[F.col(f"__o_{c}").alias(c) for c in theirs if c not in df.columns])


def fill(df: DataFrame, rows: Sequence[Mapping]) -> DataFrame:
    """The table with some rows more, given as mappings; absent columns are null, unknown ones raise."""
    if unknown := {c for r in rows for c in r} - set(df.columns):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return df.unionByName(df.sparkSession.createDataFrame([tuple(r.get(c) for c in df.columns) for r in rows], df.schema)) if rows else df


def resize(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The last ``most`` rows in order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(most).orderBy(*order)


def head(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def scan(df: DataFrame, n: int = 20, digits: int = 6) -> str:
    """The first n rows as aligned text; missing cells are a dot. For looking at, so only n rows reach the driver."""
    shown = [[("." if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(n).collect()]
    lines = [df.columns, *shown]
    widths = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(line, widths, strict=True)) for line in lines)


def score_differences(a: DataFrame, b: DataFrame, key: Sequence[str], digits: int = 8) -> DataFrame:
    """Cells of two score tables that differ; numbers are compared to ``digits`` significant digits."""

    def rounded(df: DataFrame) -> DataFrame:
        out = {}
        for c, t in df.dtypes:
            if c not in key and t in ("double", "float"):
                x = F.col(c).cast("double")
                place = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
                out[c] = F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x * place) / place)
        return df.withColumns(out) if out else df

    return difference(rounded(a), rounded(b), key)


def gini_joint(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Impurity of two label columns taken as one, weighted by the sizes of both: (n_a·G_a + n_b·G_b) / (n_a + n_b)."""
    x, y = gini(df, a, by).withColumnRenamed("gini", "__ga"), gini(df, b, by).withColumnRenamed("gini", "__gb")
    n = df.groupBy(*by).agg(F.count(a).alias("__na"), F.count(b).alias("__nb"))
    both = n.join(x, list(by), "left").join(y, list(by), "left") if by else n.crossJoin(F.broadcast(x)).crossJoin(F.broadcast(y))  # One row each without keys.
    return both.select(*by, F.try_divide(F.col("__na") * F.coalesce("__ga", F.lit(0.0)) + F.col("__nb") * F.coalesce("__gb", F.lit(0.0)), F.col("__na") + F.col("__nb")).alias("gini"))


# Vector helpers.


def discretize(x: Column, boundaries: Sequence[float]) -> Column:
    """Right-closed bins: the number of boundaries below x."""
    return reduce(lambda a, b: a + b, [(x > v).cast("int") for v in boundaries])


def linear_bins(x: Column, low: float, width: float) -> Column:
    return F.floor((x - low) / width)


def range_cap(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dict_map(x: Column, mapping: Mapping, default: object = None, keep: bool = True) -> Column:
    """Literal lookup; unmatched values stay, or take the default."""
    found = F.try_element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), x)
    return F.coalesce(found, x) if keep else F.coalesce(found, F.lit(default))


def gini(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Impurity 1 - Σp² of each group."""
    cells = df.where(F.col(label).isNotNull()).groupBy(*by, label).count()
    return cells.groupBy(*by).agg((1 - F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2.0))).alias("gini"))


# Plot data.


def freedman_diaconis(df: DataFrame, x: str, padding: float = 0.2) -> tuple[float, float, int]:
    """(low, high, bins): width 2·IQR·n^(-1/3), the range padded."""
    r = df.agg(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).first()
    if not r["n"]:
        return 0.0, 1.0, 10
    q1, q3 = blocks.percentiles(df, [], x, (0.25, 0.75)).first()["levels"]
    span = (r["b"] - r["a"]) or 1.0
    low, high = r["a"] - padding * span / 2, r["b"] + padding * span / 2
    width = 2 * (q3 - q1) / max(1, r["n"]) ** (1 / 3)
    return low, high, max(1, int((high - low) / width)) if width > 0 else 10


def heat_map(df: DataFrame, x: str, y: str, bins: tuple[int, int], box: tuple[float, float, float, float], z: str | None = None, mean: bool = False) -> DataFrame:
    """(x_bin, y_bin, value): counts, or sums or means of z, over a grid; the upper edges are closed."""
    x0, x1, y0, y1 = box
    place = lambda c, a, b, n: F.least(F.floor((F.col(c) - a) / ((b - a) / n)), F.lit(n - 1)).cast("int")
    rows = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    value = F.count(F.lit(1)).cast("double") if z is None else F.avg(z) if mean else F.sum(z)
    return rows.groupBy(place(x, x0, x1, bins[0]).alias("x_bin"), place(y, y0, y1, bins[1]).alias("y_bin")).agg(value.alias("value"))


def box_and_whisker(df: DataFrame, x: str, y: str, low: float | None = None, high: float | None = None, slices: int = 8, levels: Sequence[float] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """(slice, levels): exact percentiles of y in slices of x. A limit left out is the least or largest x, which then lies in the outermost slice."""
    rows, top = df.where(F.col(x).isNotNull()), None
    if low is None or high is None:
        r = rows.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
        top = r["b"] if high is None else None
        low, high = (r["a"] if low is None else low), (r["b"] if high is None else high)
        if low is None or high is None:
            low, high, rows = 0.0, 1.0, rows.where(F.lit(False))
    width = ((high - low) / slices) or 1.0
    rows = rows.where((F.col(x) >= low) & (F.col(x) < high if top is None else F.col(x) <= high))
    place = F.floor((F.col(x) - low) / width)
    sliced = rows.select((place if top is None else F.least(place, F.lit(slices - 1))).cast("int").alias("slice"), F.col(y).alias("__v"))
    return blocks.percentiles(sliced, ["slice"], "__v", levels)


def curve(spark, text: str, low: float, high: float, samples: int) -> DataFrame:
    """(x, y) of a formula of x at evenly spaced places."""
    xs = spark.range(samples).select((F.lit(float(low)) + F.col("id") * ((high - low) / max(1, samples - 1))).alias("x"))
    return xs.select("x", formula.column(text).alias("y"))
