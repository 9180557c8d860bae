"""Functions of the table language: plain columns without masks, NaN is a value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.masked import floor_div, floor_mod

TABLE: dict[str, Callable[..., Column]] = {}
INF = float("inf")


def _add(names: str, fn: Callable[..., Column]) -> None:
    for n in names.split():
        TABLE[n] = fn


def next_after(a: Column, b: Column) -> Column:
    """The neighbouring double towards ``b``; no JVM function does this, so one Arrow batch at a time."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))

    return run(a.cast("double"), b.cast("double"))


def _maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _minimum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


_add("add +", lambda a, b: a + b)
_add("subtract", lambda a, b: a - b)
_add("-", lambda a, b=None: -a if b is None else a - b)
_add("multiply *", lambda a, b: a * b)
_add("divide true_divide /", lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))
_add("floor_divide //", floor_div)
_add("negative", lambda a: -a)
_add("power ** pow", lambda a, b: F.pow(a, b))
_add("remainder mod %", floor_mod)
_add("fmod", F.try_mod)
_add("absolute abs", F.abs)
_add("rint", F.rint)
_add("round", lambda x, n=None: F.bround(x, 0) if n is None else F.bround(x, n))
_add("sign", F.signum)
_add("conj", lambda x: x)
for _names, _fn in {
    "exp": F.exp, "log": F.ln, "log2": F.log2, "log10": F.log10, "expm1": F.expm1, "log1p": F.log1p, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin asin": F.asin, "arccos acos": F.acos, "arctan atan": F.atan, "arctan2 atan2": F.atan2, "hypot": F.hypot, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh asinh": F.asinh, "arccosh acosh": F.acosh, "arctanh atanh": F.atanh, "deg2rad": F.radians, "rad2deg": F.degrees, "isnan": F.isnan,
}.items():
    _add(_names, _fn)
_add("square sqr", lambda x: x * x)
_add("reciprocal", lambda x: F.try_divide(F.lit(1.0), x.cast("double")))
_add("bitwise_and &", lambda a, b: a.bitwiseAND(b))
_add("bitwise_or |", lambda a, b: a.bitwiseOR(b))
_add("bitwise_xor ^", lambda a, b: a.bitwiseXOR(b))
_add("invert bitwise_not ~", F.bitwise_not)


def _shift(a: Column, b: Column, left: bool) -> Column:
    """Shifts of 64-bit whole numbers by a column; only the last six bits of ``b`` count."""
    return F.call_function("shiftleft" if left else "shiftright", a.cast("bigint"), b.cast("int"))


def _negative(x: Column) -> Column:
    """Whether the sign is set, also that of a zero."""
    return (x < 0) | ((x == 0) & (x.cast("double").cast("string") == "-0.0"))


_add("left_shift <<", lambda a, b: _shift(a, b, True))
_add("right_shift >>", lambda a, b: _shift(a, b, False))
_add("greater >", lambda a, b: a > b)
_add("greater_equal >=", lambda a, b: a >= b)
_add("less <", lambda a, b: a < b)
_add("less_equal <=", lambda a, b: a <= b)
_add("not_equal != <>", lambda a, b: a != b)
_add("equal == =", lambda a, b: a == b)
_add("logical_and and", lambda *a: reduce(lambda x, y: x & y, a))
_add("logical_or or", lambda *a: reduce(lambda x, y: x | y, a))
_add("logical_xor xor", lambda *a: reduce(lambda x, y: x != y, a))
_add("logical_not not", lambda a: ~a)
_add("maximum", _maximum)
_add("minimum", _minimum)
_add("isinf", lambda x: F.abs(x) == INF)
_add("isfinite", lambda x: ~F.isnan(x) & (F.abs(x) != INF))
_add("signbit", _negative)
_add("ldexp", lambda x, n: x * F.pow(F.lit(2.0), n.cast("double")))
_add("floor", F.floor)
_add("ceil", F.ceil)
_add("isin isIn in", lambda x, *s: reduce(lambda p, q: p | q, [x == y for y in s]))
_add("notin isNotIn", lambda x, *s: ~reduce(lambda p, q: p | q, [x == y for y in s]))
_add("between", lambda x, a, b: x.between(a, b))
_add("notBetween", lambda x, a, b: ~x.between(a, b))
_add("like", lambda x, p: F.regexp_like(x, F.concat(F.lit("^(?:"), p, F.lit(")"))))
_add("logaddexp", lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
_add("logaddexp2", lambda a, b: F.greatest(a, b) + F.log1p(F.pow(F.lit(2.0), -F.abs(a - b))) / F.lit(float(np.log(2))))
_add("exp2", lambda x: F.pow(F.lit(2.0), x))
_add("copysign", lambda a, b: F.abs(a) * F.when(_negative(b), -1).otherwise(1))
_add("nextafter", next_after)
_add("trunc", lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
_add("if", lambda c, t, e=None: F.when(c, t) if e is None else F.when(c, t).otherwise(e))
