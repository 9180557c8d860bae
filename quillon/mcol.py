"""Columns with three states. NULL alone cannot tell missing from invalid, so a value travels with a mask."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID, MISSING, INVALID = 0, 1, 2


@dataclass(frozen=True)
class MCol:
    """``value`` is NULL wherever ``mask`` is not 0; ``mask=None`` means provably valid, so no mask code is planned."""

    value: Column
    mask: Column | None = None

    @property
    def state(self) -> Column:
        return F.lit(VALID) if self.mask is None else self.mask

    def edge(self) -> Column:
        """The value as users see it: NULL where not valid."""
        return self.value


def source(col: Column, floating: bool = False) -> MCol:
    """A nullable input: NULL, and NaN of floating columns, are MISSING."""
    gone = (col.isNull() | F.isnan(col)) if floating else col.isNull()
    return MCol(F.when(~gone, col) if floating else col, F.when(gone, MISSING).otherwise(VALID))


def literal(value: object, spark_type: str | None = None) -> MCol:
    col = F.lit(value)
    return MCol(col.cast(spark_type) if spark_type else col)


def joint(args: Sequence[MCol]) -> Column | None:
    """Mask of a propagating operator: INVALID beats MISSING beats VALID."""
    masks = [a.mask for a in args if a.mask is not None]
    if not masks:
        return None
    return masks[0] if len(masks) == 1 else F.greatest(*masks)


def guarded(value: Column, mask: Column | None) -> MCol:
    return MCol(value, None) if mask is None else MCol(F.when(mask == VALID, value), mask)


def propagate(value: Column, args: Sequence[MCol]) -> MCol:
    """Rule P."""
    return guarded(value, joint(args))


def checked(value: Column, args: Sequence[MCol], floating: bool = True) -> MCol:
    """Rules P and N: NULL, NaN and infinite results of valid arguments are INVALID."""
    before = joint(args)
    bad = value.isNull()
    if floating:
        bad = bad | F.isnan(value) | (F.abs(value) == float("inf"))
    mask = F.when(bad, INVALID).otherwise(VALID) if before is None else F.when(before != VALID, before).when(bad, INVALID).otherwise(VALID)
    return MCol(F.when(mask == VALID, value), mask)


def any_valid(args: Sequence[MCol]) -> Column | None:
    """Whether some argument is valid; None if that is certain."""
    if any(a.mask is None for a in args):
        return None
    return reduce(lambda a, b: a | b, [a.mask == VALID for a in args])


def skipping(value: Column, args: Sequence[MCol], otherwise: int = MISSING) -> MCol:
    """Rule K: only all arguments being non-valid makes the result so."""
    some = any_valid(args)
    if some is None:
        return MCol(value)
    return MCol(F.when(some, value), F.when(some, VALID).otherwise(otherwise))
