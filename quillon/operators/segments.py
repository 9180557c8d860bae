"""Automatic segmentation: whitelist, generic and blacklist segments from enumerated and partitioned dimensions.

A schema becomes one key column: rows of a blacklisted segment are dropped, whitelisted ones keep their own
key, all others fall into the generic segments. New segments need no bookkeeping: they are new keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.ir import Node
from quillon.plans.types import in_interval


def _dimension(node: Node) -> tuple[Column, Column]:
    """(matches, label) of one dimension. No Selection means any value."""
    field = node.need("field")
    if node.tag == "EnumeratedDimension":
        values = [s.need("value") for s in node.all("Selection")]
        text = F.col(field).cast("string")
        return (text.isin(values) if values else text.isNotNull()), text
    parts = []
    for p in node.all("Partition"):
        low, high, n = p.number("low"), p.number("high"), p.number("divisions", 1.0)
        x = F.col(field).cast("double")
        hit = in_interval(x, p.get("closure", "closedOpen"), low, high)
        if n and n > 1 and low is not None and high is not None:
            step = (high - low) / n
            place = F.least(F.floor((x - low) / step), F.lit(n - 1))
            label = F.concat(F.lit(f"{low:g}..{high:g}#"), place.cast("int").cast("string"))
        else:
            label = F.lit(f"{p.get('low', '')}..{p.get('high', '')}")
        parts.append((hit, label))
    hit = reduce(lambda a, b: a | b, [h for h, _ in parts])
    label = reduce(lambda a, b: F.coalesce(a, b), [F.when(h, v) for h, v in parts])
    return hit, label


def _groups(schema: Node, tag: str) -> list[tuple[Column, Column]]:
    out = []
    for g in schema.all(tag):
        dims = [_dimension(d) for d in g.children if d.tag.endswith("Dimension")]
        if dims:
            names = [d.need("field") for d in g.children if d.tag.endswith("Dimension")]
            hit = F.coalesce(reduce(lambda a, b: a & b, [h for h, _ in dims]), F.lit(False))
            out.append((hit, F.concat_ws(",", *[F.concat(F.lit(f"{n}="), v) for n, (_, v) in zip(names, dims, strict=True)])))
    return out


def segment_key(df: DataFrame, schema: Node, out: str = "segment") -> DataFrame:
    """Adds the segment key; rows of blacklisted or no segments are dropped. The first group that matches wins, whitelists before generic ones."""
    black = _groups(schema, "BlacklistedSegments")
    allowed = _groups(schema, "WhitelistedSegments") + _groups(schema, "GenericSegment")
    key = F.lit(None).cast("string")
    for hit, label in reversed(allowed):
        key = F.when(hit, label).otherwise(key)
    rows = df.where(~reduce(lambda a, b: a | b, [h for h, _ in black])) if black else df
    return rows.withColumn(out, key).where(F.col(out).isNotNull())


def mature(df: DataFrame, segment: str, order: list[str], threshold: int, score: Column, out: str = "score") -> DataFrame:
    """Scores only once ``threshold`` earlier rows of the segment are known: score first, learn after."""
    from pyspark.sql import Window as W

    seen = F.count(F.lit(1)).over(W.partitionBy(segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(out, F.when(seen >= threshold, score))


def zero_variance(x: Column, mean: Column, variance: Column, policy: str = "quiet", default: float | None = None) -> Column:
    """z-value with a policy for no variance: quiet (null), default, or interpolate (the sign of the difference at infinity)."""
    z = F.try_divide(x - mean, F.sqrt(F.when(variance > 0, variance)))
    if policy == "default":
        return F.coalesce(z, F.when(variance == 0, F.lit(default)))
    if policy == "interpolate":
        return F.coalesce(z, F.when(variance == 0, F.when(x == mean, 0.0).otherwise(F.signum(x - mean) * float("inf"))))
    return z
