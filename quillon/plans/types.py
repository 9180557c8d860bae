"""Field types of the model language and the validity they declare."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.mcol import INVALID, MISSING, VALID, MCol
from quillon.plans.ir import ModelError, Node

#: Data types of the standard and their Spark types.
SPARK_TYPES = {
    "string": "string", "integer": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "time": "bigint", "timeSeconds": "bigint",
    **{f"dateDaysSince[{y}]": "bigint" for y in (0, 1960, 1970, 1980)}, **{f"dateTimeSecondsSince[{y}]": "bigint" for y in (0, 1960, 1970, 1980)},
}


@dataclass(frozen=True)
class FieldType:
    """dataType × optype × declared values × intervals × cyclic."""

    name: str
    data_type: str = "double"
    optype: str = "continuous"
    valid: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    invalid: tuple[str, ...] = ()
    intervals: tuple[tuple[str, float | None, float | None], ...] = ()
    cyclic: bool = False

    @property
    def spark(self) -> str:
        if self.data_type not in SPARK_TYPES:
            raise ModelError(f"unknown dataType {self.data_type!r}")
        return SPARK_TYPES[self.data_type]


def read_type(node: Node) -> FieldType:
    values = node.all("Value")
    kinds = {k: tuple(v.need("value") for v in values if v.get("property", "valid") == k) for k in ("valid", "missing", "invalid")}
    intervals = tuple((i.get("closure", "closedClosed"), i.number("leftMargin"), i.number("rightMargin")) for i in node.all("Interval"))
    return FieldType(node.need("name"), node.get("dataType", "double"), node.get("optype", "continuous"), kinds["valid"], kinds["missing"], kinds["invalid"], intervals, node.get("isCyclic", "0") in ("1", "true"))


def in_interval(x: Column, closure: str, low: float | None, high: float | None) -> Column:
    """closure is openClosed, openOpen, closedOpen or closedClosed; a margin may be absent."""
    out = F.lit(True)
    if low is not None:
        out = out & (x > low if closure.startswith("open") else x >= low)
    if high is not None:
        out = out & (x < high if closure.endswith("Open") else x <= high)
    return out


def cast(col: MCol, kind: FieldType) -> MCol:
    """Casts and judges validity: values that fail to cast are INVALID, as are those the declaration rules out.

    Where valid values are declared anything else is invalid; else anything not declared invalid is valid.
    """
    raw = col.value
    text = raw.cast("string")
    value = _since(text, kind.data_type) if _EPOCH.match(kind.data_type) else raw.try_cast(kind.spark)
    if kind.cyclic:
        ends = [v for _, a, b in kind.intervals for v in (a, b) if v is not None] or [float(v) for v in kind.valid if _numeric(v)]
        if ends:
            value = wrap(value, min(ends), max(ends)).cast(kind.spark)
            text = value.cast("string")
    if kind.spark in ("double", "float"):
        gone = raw.isNull() | F.isnan(F.coalesce(value, F.lit(0.0)))
    else:
        gone = raw.isNull()
    if kind.missing:
        gone = gone | text.isin(list(kind.missing))
    bad = value.isNull()
    if kind.valid:
        bad = bad | ~text.isin(list(kind.valid))
    if kind.invalid:
        bad = bad | text.isin(list(kind.invalid))
    if kind.intervals:
        inside = F.lit(False)
        for closure, low, high in kind.intervals:
            inside = inside | in_interval(value, closure, low, high)
        bad = bad | ~inside
    before = F.lit(VALID) if col.mask is None else col.mask
    mask = F.when(before != VALID, before).when(gone, MISSING).when(bad, INVALID).otherwise(VALID)
    return MCol(F.when(mask == VALID, value), mask)


_EPOCH = re.compile(r"(dateDays|dateTimeSeconds)Since\[(\d+)\]$|timeSeconds$|time$")


def _since(text: Column, data_type: str) -> Column:
    """Days or seconds since a year's start from a number, a date or a timestamp; times of day modulo one day."""
    m = _EPOCH.match(data_type)
    if m[1] is None:
        parts = F.split(text, ":")
        clock = parts[0].try_cast("bigint") * 3600 + parts[1].try_cast("bigint") * 60 + parts[2].try_cast("double").cast("bigint")
        return F.pmod(F.coalesce(text.try_cast("bigint"), F.when(F.size(parts) == 3, clock)), F.lit(86_400))
    epoch = f"{int(m[2]):04d}-01-01"
    if m[1] == "dateDays":
        return F.coalesce(text.try_cast("bigint"), F.date_diff(text.try_cast("date"), F.to_date(F.lit(epoch))).cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), F.unix_seconds(text.try_cast("timestamp")) - F.unix_seconds(F.lit(epoch).cast("timestamp")))


def wrap(value: Column, first: float, last: float) -> Column:
    """A cyclic value brought back into [first, last] after arithmetic."""
    return F.pmod(value - first, F.lit(last - first + 1)) + first


def treats(node: Node) -> bool:
    """Whether a MiningField changes anything."""
    return node.get("outliers", "asIs") != "asIs" or node.get("invalidValueTreatment") == "asMissing" or node.get("missingValueReplacement") is not None


def mining_field(col: MCol, node: Node) -> MCol:
    """Outlier, invalid-value and missing-value treatment of a MiningField, in that order."""
    if not treats(node):
        return col
    value, mask = col.value, col.state
    low, high = node.number("lowValue"), node.number("highValue")
    outliers = node.get("outliers", "asIs")
    if outliers == "asExtremeValues":
        if low is not None:
            value = F.when(value < low, F.lit(low)).otherwise(value)
        if high is not None:
            value = F.when(value > high, F.lit(high)).otherwise(value)
    elif outliers == "asMissingValues":
        out = F.lit(False)
        if low is not None:
            out = out | (value < low)
        if high is not None:
            out = out | (value > high)
        mask = F.when((mask == VALID) & out, MISSING).otherwise(mask)
    treatment = node.get("invalidValueTreatment", "returnInvalid")
    if treatment == "asMissing":
        mask = F.when(mask == INVALID, MISSING).otherwise(mask)
    replacement = node.get("missingValueReplacement")
    if replacement is not None:
        fill = F.when(mask == MISSING, F.lit(replacement).try_cast("double") if _numeric(replacement) else F.lit(replacement))
        value = F.coalesce(F.when(mask == VALID, value), fill)
        mask = F.when(mask == MISSING, VALID).otherwise(mask)
    return MCol(F.when(mask == VALID, value), mask)


def _numeric(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True
