"""Functions of the model language: name → builder over masked columns.

Rules: P propagates non-valid arguments, N makes non-finite results invalid, Z zero denominators, K skips
non-valid arguments. ``legacy=True`` selects the older row engine's variants where the two differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.mcol import INVALID, MISSING, VALID, MCol, any_valid, checked, guarded, joint, propagate, skipping

Builder = Callable[[list[MCol]], MCol]
TABLE: dict[str, Builder] = {}
LEGACY: dict[str, Builder] = {}


def _add(names: str, fn: Builder, table: dict[str, Builder] = TABLE) -> None:
    for n in names.split():
        table[n] = fn


def _p(fn: Callable[..., Column]) -> Builder:
    return lambda a: propagate(fn(*(x.value for x in a)), a)


def _n(fn: Callable[..., Column]) -> Builder:
    return lambda a: checked(fn(*(x.value for x in a)), a)


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double")))


_add("+", _p(F.try_add))
_add("-", lambda a: propagate(F.try_subtract(a[0].value, a[1].value), a) if len(a) == 2 else propagate(-a[0].value, a))
_add("*", _p(F.try_multiply))
_add("/", _n(lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))))
_add("negative", _p(lambda a: -a))
_add("//", lambda a: checked(floor_div(a[0].value, a[1].value), a, floating=False))
_add("mod %", lambda a: checked(floor_mod(a[0].value, a[1].value), a, floating=False))
_add("fmod", lambda a: checked(F.try_mod(a[0].value, a[1].value), a, floating=False))
_add("pow **", _n(lambda a, b: F.pow(a, b)))
for _name, _fn in {"log10": F.log10, "ln": F.ln, "sqrt": F.sqrt, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctanh": F.atanh}.items():
    _add(_name, _n(_fn))
for _name, _fn in {"abs": F.abs, "exp": F.exp, "sin": F.sin, "cos": F.cos, "arctan": F.atan, "arctan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh}.items():
    _add(_name, _p(_fn))
_add("sinN", _p(lambda x, n: F.sin(x * n)))
_add("cosN", _p(lambda x, n: F.cos(x * n)))
_add("floor", _p(lambda x: F.floor(x).cast("double")))
_add("ceil", _p(lambda x: F.ceil(x).cast("double")))
_add("round", _p(F.rint))
_add("threshold", _p(lambda a, b: (a > b).cast("int")))


def _fold(a: list[MCol], neutral: object, op: Callable[[Column, Column], Column]) -> Column:
    return reduce(op, [x.value if x.mask is None else F.coalesce(x.value, F.lit(neutral)) for x in a])


def _valid_count(a: list[MCol]) -> Column:
    return reduce(lambda x, y: x + y, [F.lit(1) if x.mask is None else (x.mask == VALID).cast("int") for x in a])


def _least_greatest(fn: Callable[..., Column]) -> Builder:
    return lambda a: skipping(fn(*(x.value for x in a)) if len(a) > 1 else a[0].value, a)


def _median(a: list[MCol]) -> MCol:
    kept = F.array_sort(F.array_compact(F.array(*(x.value.cast("double") for x in a))))
    n = F.size(kept)
    mid = (F.try_element_at(kept, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(kept, (F.floor(n / 2) + 1).cast("int"))) / 2
    some = any_valid(a)
    return MCol(mid) if some is None else MCol(F.when(some, mid), F.when(some, VALID).otherwise(INVALID))


_add("min", _least_greatest(F.least))
_add("max", _least_greatest(F.greatest))
_add("sum", lambda a: MCol(_fold(a, 0, lambda x, y: x + y)))
_add("product", lambda a: MCol(_fold(a, 1, lambda x, y: x * y)))
_add("avg", lambda a: skipping(F.try_divide(_fold(a, 0, lambda x, y: x + y).cast("double"), _valid_count(a).cast("double")), a, INVALID))
_add("median", _median)
_add("and", lambda a: skipping(_fold(a, True, lambda x, y: x & y), a))
_add("or", lambda a: skipping(_fold(a, False, lambda x, y: x | y), a))
_add("xor", lambda a: skipping(_fold(a, False, lambda x, y: x != y), a))
_add("not", _p(lambda x: ~x))

_add("isMissing", lambda a: MCol(a[0].state == MISSING))
_add("isNotMissing", lambda a: MCol(a[0].state != MISSING))
for _names, _fn in {"equal == =": lambda a, b: a == b, "notEqual != <>": lambda a, b: a != b, "lessThan <": lambda a, b: a < b, "lessOrEqual <=": lambda a, b: a <= b, "greaterThan >": lambda a, b: a > b, "greaterOrEqual >=": lambda a, b: a >= b}.items():
    _add(_names, _p(_fn))
_add("isIn in", _p(lambda x, *s: reduce(lambda p, q: p | q, [x == y for y in s])))
_add("isNotIn notin", _p(lambda x, *s: ~reduce(lambda p, q: p | q, [x == y for y in s])))
_add("between", _p(lambda x, lo, hi: x.between(lo, hi)))
_add("notBetween", _p(lambda x, lo, hi: ~x.between(lo, hi)))
_add("like", _p(lambda x, p: F.regexp_like(x, F.concat(F.lit("^(?:"), p, F.lit(")")))))


def _if(a: list[MCol]) -> MCol:
    """Branches are evaluated on their rows only; without an else, other rows are MISSING."""
    c, t = a[0], a[1]
    e = a[2] if len(a) == 3 else None
    value = F.when(c.value, t.value)
    state = F.when(c.state != VALID, c.state).when(c.value, t.state)
    if e is None:
        return MCol(value, state.otherwise(MISSING))
    return MCol(value.when(~c.value, e.value), state.otherwise(e.state)) if any(x.mask is not None for x in a) else MCol(value.otherwise(e.value))


_add("if", _if)


def _substring(a: list[MCol]) -> MCol:
    s, start, size = (x.value for x in a)
    ok = (start >= 1) & (size >= 0) & (start <= F.length(s))
    return checked(F.when(ok, F.substring(s, start.cast("int"), size.cast("int"))), a, floating=False)


_add("uppercase", _p(F.upper))
_add("lowercase", _p(F.lower))
_add("substring", _substring)
_add("trimBlanks", _p(lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")))
_add("formatNumber", _p(lambda x, f: F.printf(f, x)))

#: Strftime directives and their Spark patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "f": "SSSSSS"}


def spark_pattern(fmt: str) -> str:
    """A strftime format as a Spark datetime pattern."""
    out = []
    for m in re.finditer(r"%(.)|([^%]+)", fmt):
        if m[1] == "%":
            out.append("%")
        elif m[1]:
            out.append(STRFTIME[m[1]])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda w: f"'{w.group()}'", m[2]))
    return "".join(out)


def format_datetime(a: list[MCol], fmt: str) -> MCol:
    return propagate(F.date_format(a[0].value, spark_pattern(fmt)), a)


def _since(a: list[MCol]) -> Column:
    at = a[0].value.cast("timestamp")
    return F.unix_micros(at) - F.unix_micros(F.make_timestamp(a[1].value.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


_add("dateDaysSinceYear", lambda a: propagate(_since(a) / 86_400e6, a))
_add("dateSecondsSinceYear", lambda a: propagate(_since(a) / 1e6, a))
_add("dateSecondsSinceMidnight", lambda a: propagate(F.pmod(F.unix_micros(a[0].value.cast("timestamp")), F.lit(86_400_000_000)) / 1e6, a))

# The older row engine's variants.
LEGACY.update(TABLE)
_add("/", lambda a: checked(F.try_divide(a[0].value, a[1].value), a), LEGACY)
_add("/i", lambda a: checked(floor_div(a[0].value, a[1].value).cast("bigint"), a, floating=False), LEGACY)
_add("round", _p(lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)), LEGACY)
_add("equal ==", _p(lambda a, b: F.rtrim(a.cast("string")) == F.rtrim(b.cast("string"))), LEGACY)
_add("notEqual !=", _p(lambda a, b: F.rtrim(a.cast("string")) != F.rtrim(b.cast("string"))), LEGACY)
_add("and", _p(lambda a, b: a & b), LEGACY)
_add("or", _p(lambda a, b: a | b), LEGACY)
_add("dateDaysSinceYear", lambda a: propagate(F.floor(_since(a) / 86_400e6).cast("bigint"), a), LEGACY)
_add("min", _p(lambda *x: F.least(*x)), LEGACY)
_add("max", _p(lambda *x: F.greatest(*x)), LEGACY)
_add("sum", _p(lambda *x: reduce(lambda p, q: p + q, x)), LEGACY)
_add("avg", _p(lambda *x: reduce(lambda p, q: p + q, x) / F.lit(float(len(x)))), LEGACY)


def _legacy_substring(a: list[MCol]) -> MCol:
    s, start, size = (x.value for x in a)
    ok = (start >= 1) & (size >= 0)
    return checked(F.when(ok, F.substring(s, start.cast("int"), size.cast("int"))), a, floating=False)


_add("substring", _legacy_substring, LEGACY)
for _gone in ("median", "product", "negative"):
    LEGACY.pop(_gone, None)

__all__ = ["LEGACY", "TABLE", "floor_div", "floor_mod", "format_datetime", "guarded", "joint", "spark_pattern"]
