"""Queries of the scalar functions: one for each function of each dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import formula
from quillon.mcol import MCol, source
from quillon.registry import query
from quillon.session import table

#: Columns of the test frame: name → (Spark SQL and DuckDB expression, floating).
_COLUMNS = {
    "x": ("CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 50 END", True),
    "y": ("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 10 + 0.5 END", True),
    "u": ("CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 19 - 9 AS DOUBLE) / 10 END", True),
    "i": ("event_id % 13 - 6", False),
    "j": ("CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 5 - 2 END", False),
    "k": ("event_id % 6", False),
    "s": ("CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('  ', event_type, ' ') END", False),
    "w": ("event_type", False),
    "p": ("CASE WHEN event_id % 4 = 0 THEN NULL ELSE value > 50 END", False),
    "q": ("CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 20 END", False),
    "t": ("ts", False),
}
_CTE = "WITH e AS (SELECT event_id, " + ", ".join(f"{e} AS {n}" for n, (e, _) in _COLUMNS.items()) + " FROM events) "


def frame(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.selectExpr("event_id", *(f"{e} AS {n}" for n, (e, _) in _COLUMNS.items()))


def scope() -> dict[str, MCol]:
    always = {"i", "k", "w", "t"}
    return {n: MCol(F.col(n)) if n in always else source(F.col(n), floating) for n, (_, floating) in _COLUMNS.items()}


def _shown(col, kind: str):
    return F.round(col.cast("double"), 6) if kind == "num" else col


def _masked(name: str, text: str, sql: str, mask: str, kind: str, legacy: bool) -> None:
    shown = f"round(CAST({sql} AS DOUBLE), 6)" if kind == "num" else sql

    @query(name, f"{_CTE}, r AS (SELECT *, {shown} AS r FROM e) SELECT event_id, r, CAST({mask} AS INTEGER) AS m FROM r".replace(" , r AS", ", r AS"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = formula.compile_masked(formula.parse(text), scope(), legacy)
        return frame(spark, d).select("event_id", _shown(out.edge(), kind).alias("r"), out.state.cast("int").alias("m"))


def _p(*names: str) -> str:
    """Mask of rules P and N: missing arguments, then results that came to nothing."""
    nulls = " OR ".join(f"{n} IS NULL" for n in names) or "FALSE"
    return f"CASE WHEN {nulls} THEN 1 WHEN r IS NULL THEN 2 ELSE 0 END"


def _k(*names: str, bad: int = 1) -> str:
    return f"CASE WHEN {' AND '.join(f'{n} IS NULL' for n in names)} THEN {bad} ELSE 0 END"


_ROWS = [
    ("add", "x + y", "x + y", _p("x", "y"), "num"),
    ("subtract", "x - y", "x - y", _p("x", "y"), "num"),
    ("multiply", "x * y", "x * y", _p("x", "y"), "num"),
    ("divide", "x / j", "CASE WHEN j <> 0 THEN x / j END", _p("x", "j"), "num"),
    ("min", "min(x, y, u)", "least(x, y, u)", _k("x", "y", "u"), "num"),
    ("max", "max(x, y, u)", "greatest(x, y, u)", _k("x", "y", "u"), "num"),
    ("sum", "sum(x, y, j)", "coalesce(x, 0) + coalesce(y, 0) + coalesce(j, 0)", "0", "num"),
    ("avg", "avg(x, y)", "(coalesce(x, 0) + coalesce(y, 0)) / nullif((x IS NOT NULL)::INT + (y IS NOT NULL)::INT, 0)", _k("x", "y", bad=2), "num"),
    ("median", "median(x, y, u)", "list_median(list_filter([x, y, u], lambda v: v IS NOT NULL))", _k("x", "y", "u", bad=2), "num"),
    ("product", "product(x, y)", "coalesce(x, 1) * coalesce(y, 1)", "0", "num"),
    ("log10", "log10(x)", "CASE WHEN x > 0 THEN log10(x) END", _p("x"), "num"),
    ("ln", "ln(x)", "CASE WHEN x > 0 THEN ln(x) END", _p("x"), "num"),
    ("sqrt", "sqrt(x)", "CASE WHEN x >= 0 THEN sqrt(x) END", _p("x"), "num"),
    ("abs", "abs(x)", "abs(x)", _p("x"), "num"),
    ("exp", "exp(u)", "exp(u)", _p("u"), "num"),
    ("pow", "pow(x, k)", "CASE WHEN x IS NOT NULL THEN round(pow(x, k), 2) END", _p("x"), "pow"),
    ("power_op", "y ** 2", "pow(y, 2)", _p("y"), "num"),
    ("threshold", "threshold(x, y)", "CAST(x > y AS INTEGER)", _p("x", "y"), "int"),
    ("floor", "floor(x)", "floor(x)", _p("x"), "num"),
    ("ceil", "ceil(x)", "ceil(x)", _p("x"), "num"),
    ("round", "round(j / 2)", "round_even(j / 2, 0)", _p("j"), "num"),
    ("is_missing", "isMissing(x)", "x IS NULL", "0", "bool"),
    ("is_not_missing", "isNotMissing(x)", "x IS NOT NULL", "0", "bool"),
    ("equal", "i == j", "i = j", _p("j"), "bool"),
    ("not_equal", "notEqual(i, j)", "i <> j", _p("j"), "bool"),
    ("less_than", "x < y", "x < y", _p("x", "y"), "bool"),
    ("less_or_equal", "i <= j", "i <= j", _p("j"), "bool"),
    ("greater_than", "x > y", "x > y", _p("x", "y"), "bool"),
    ("greater_or_equal", "i >= j", "i >= j", _p("j"), "bool"),
    ("and", "p and q", "CASE WHEN p IS NOT NULL OR q IS NOT NULL THEN coalesce(p, TRUE) AND coalesce(q, TRUE) END", _k("p", "q"), "bool"),
    ("or", "p or q", "CASE WHEN p IS NOT NULL OR q IS NOT NULL THEN coalesce(p, FALSE) OR coalesce(q, FALSE) END", _k("p", "q"), "bool"),
    ("not", "not p", "NOT p", _p("p"), "bool"),
    ("is_in", "i in {1, 2, 5}", "i IN (1, 2, 5)", "0", "bool"),
    ("is_not_in", "j not in {1, 2}", "j NOT IN (1, 2)", _p("j"), "bool"),
    ("if", "if(p, x, y)", "CASE WHEN p THEN x WHEN NOT p THEN y END", "CASE WHEN p IS NULL THEN 1 WHEN p AND x IS NULL THEN 1 WHEN NOT p AND y IS NULL THEN 1 ELSE 0 END", "num"),
    ("if_without_else", "if(p, x)", "CASE WHEN p THEN x END", "CASE WHEN p AND x IS NOT NULL THEN 0 ELSE 1 END", "num"),
    ("uppercase", "uppercase(s)", "upper(s)", _p("s"), "str"),
    ("lowercase", "lowercase(uppercase(s))", "lower(s)", _p("s"), "str"),
    ("substring", "substring(w, k, 2)", "CASE WHEN k >= 1 AND k <= length(w) THEN substr(w, k, 2) END", _p(), "str"),
    ("trim_blanks", "trimBlanks(s)", "trim(s)", _p("s"), "str"),
    ("format_number", "formatNumber(x, '%8.3f')", "printf('%8.3f', x)", _p("x"), "str"),
    ("format_datetime", "formatDatetime(t, '%Y/%m/%d %H:%M:%S')", "strftime(t, '%Y/%m/%d %H:%M:%S')", _p("t"), "str"),
    ("date_days_since_year", "dateDaysSinceYear(t, 2020)", "(epoch_us(t) - epoch_us(TIMESTAMP '2020-01-01')) / 86400000000.0", _p("t"), "num"),
    ("date_seconds_since_year", "dateSecondsSinceYear(t, 2020)", "(epoch_us(t) - epoch_us(TIMESTAMP '2020-01-01')) / 1000000.0", _p("t"), "num"),
    ("date_seconds_since_midnight", "dateSecondsSinceMidnight(t)", "(epoch_us(t) % 86400000000) / 1000000.0", _p("t"), "num"),
    ("negative", "-x", "-x", _p("x"), "num"),
    ("between", "x between -10 and 30", "x BETWEEN -10 AND 30", _p("x"), "bool"),
    ("not_between", "x not between -10 and 30", "x NOT BETWEEN -10 AND 30", _p("x"), "bool"),
    ("like", "w like 'c.*k'", "regexp_matches(w, '^(?:c.*k)')", _p(), "bool"),
    ("floor_division", "i // j", "CASE WHEN j <> 0 THEN floor(i / j) END", _p("j"), "num"),
    ("mod", "i % j", "CASE WHEN j <> 0 THEN i - j * floor(i / j) END", _p("j"), "num"),
    ("fmod", "fmod(i, j)", "CASE WHEN j <> 0 THEN i % j END", _p("j"), "num"),
    ("xor", "p xor q", "CASE WHEN p IS NOT NULL OR q IS NOT NULL THEN coalesce(p, FALSE) <> coalesce(q, FALSE) END", _k("p", "q"), "bool"),
    ("sin", "sin(x)", "sin(x)", _p("x"), "num"),
    ("cos", "cos(x)", "cos(x)", _p("x"), "num"),
    ("sin_n", "sinN(u, k)", "sin(u * k)", _p("u"), "num"),
    ("cos_n", "cosN(u, k)", "cos(u * k)", _p("u"), "num"),
    ("tan", "tan(u)", "tan(u)", _p("u"), "num"),
    ("arcsin", "arcsin(j * 1.0)", "CASE WHEN abs(j) <= 1 THEN asin(j) END", _p("j"), "num"),
    ("arccos", "arccos(j * 1.0)", "CASE WHEN abs(j) <= 1 THEN acos(j) END", _p("j"), "num"),
    ("arctan", "arctan(x)", "atan(x)", _p("x"), "num"),
    ("arctan2", "arctan2(x, y)", "atan2(x, y)", _p("x", "y"), "num"),
    ("sinh", "sinh(u)", "sinh(u)", _p("u"), "num"),
    ("cosh", "cosh(u)", "cosh(u)", _p("u"), "num"),
    ("tanh", "tanh(u)", "tanh(u)", _p("u"), "num"),
    ("arcsinh", "arcsinh(x)", "asinh(x)", _p("x"), "num"),
    ("arccosh", "arccosh(y + 1)", "acosh(y + 1)", _p("y"), "num"),
    ("arctanh", "arctanh(j * 1.0)", "CASE WHEN abs(j) < 1 THEN atanh(j) END", _p("j"), "num"),
    ("chained_comparison", "-10 < x < 30", "x > -10 AND x < 30", _p("x"), "bool"),
    ("precedence", "x + y * 2 - -u / 4", "x + y * 2 + u / 4", _p("x", "y", "u"), "num"),
]
_LEGACY_ROWS = [
    ("divide_integers", "/i", "CASE WHEN j <> 0 THEN floor(i / j) END", _p("j"), "num"),
    ("round", "round(j / 2)", "sign(j) * floor(abs(j / 2) + 0.5)", _p("j"), "num"),
    ("equal_blanks", "s == '  click'", "rtrim(s) = '  click'", _p("s"), "bool"),
    ("and", "p and q", "CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE p AND q END", _p("p", "q"), "bool"),
    ("or", "p or q", "CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE p OR q END", _p("p", "q"), "bool"),
    ("substring", "substring(w, k, 2)", "CASE WHEN k >= 1 THEN substr(w, k, 2) END", _p(), "str"),
    ("date_days_since_year", "dateDaysSinceYear(t, 2020)", "date_diff('day', DATE '2020-01-01', t::DATE)", _p("t"), "num"),
    ("min", "min(x, y)", "CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE least(x, y) END", _p("x", "y"), "num"),
    ("avg", "avg(x, y)", "(x + y) / 2", _p("x", "y"), "num"),
]
for _name, _text, _sql, _mask, _kind in _ROWS:
    if _kind == "pow":
        _text, _sql, _kind = "floor(pow(x, k) * 100 + 0.5) / 100", "floor(pow(x, k) * 100 + 0.5) / 100", "num"
    _masked(f"fn_{_name}", _text, _sql, _mask, _kind, False)
for _name, _text, _sql, _mask, _kind in _LEGACY_ROWS:
    if _text == "/i":
        from quillon.functions import masked as _m

        _m.LEGACY["intdiv"] = _m.LEGACY["/i"]
        _text = "intdiv(i, j)"
    _masked(f"fn_row_{_name}", _text, _sql, _mask, _kind, True)


# Functions that both engines share, through the row engine's table.
_SHARED = {"add", "subtract", "multiply", "pow", "ln", "log10", "sqrt", "exp", "abs", "floor", "ceil", "threshold", "less_than", "less_or_equal", "greater_than", "greater_or_equal", "not", "is_missing", "is_not_missing", "is_in", "is_not_in", "uppercase", "lowercase", "trim_blanks", "if"}
for _name, _text, _sql, _mask, _kind in _ROWS:
    if _name in _SHARED and _kind != "pow":
        _masked(f"fn_row_{_name}", _text, _sql, _mask, _kind, True)
for _name, _text, _sql, _mask, _kind in [
    ("max", "max(x, y)", "CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE greatest(x, y) END", _p("x", "y"), "num"),
    ("sum", "sum(x, y)", "x + y", _p("x", "y"), "num"),
]:
    _masked(f"fn_row_{_name}", _text, _sql, _mask, _kind, True)


def _plain(name: str, text: str, sql: str, kind: str) -> None:
    shown = f"round(CAST({sql} AS DOUBLE), 6)" if kind == "num" else f"CAST({sql} AS BIGINT)" if kind == "int" else sql

    @query(f"fn_tab_{name}", f"{_CTE} SELECT event_id, {shown} AS r FROM e")
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = formula.column(text)
        return frame(spark, d).select("event_id", (out.cast("bigint") if kind == "int" else _shown(out, kind)).alias("r"))


_TABLE_ROWS = [
    ("add", "add(x, y)", "x + y", "num"), ("subtract", "subtract(x, y)", "x - y", "num"), ("multiply", "multiply(x, y)", "x * y", "num"),
    ("divide", "divide(x, j)", "CASE WHEN j <> 0 THEN x / j END", "num"), ("true_divide", "true_divide(i, j)", "CASE WHEN j <> 0 THEN i / j END", "num"),
    ("floor_divide", "floor_divide(i, j)", "CASE WHEN j <> 0 THEN floor(i / j) END", "num"), ("negative", "negative(x)", "-x", "num"), ("power", "power(y, 2)", "pow(y, 2)", "num"),
    ("remainder", "remainder(i, j)", "CASE WHEN j <> 0 THEN i - j * floor(i / j) END", "num"), ("mod", "mod(i, j)", "CASE WHEN j <> 0 THEN i - j * floor(i / j) END", "num"), ("fmod", "fmod(i, j)", "CASE WHEN j <> 0 THEN i % j END", "num"),
    ("absolute", "absolute(x)", "abs(x)", "num"), ("abs", "abs(x)", "abs(x)", "num"), ("rint", "rint(j / 2)", "round_even(j / 2, 0)", "num"), ("round", "round(j / 2)", "round_even(j / 2, 0)", "num"),
    ("sign", "sign(x)", "sign(x)", "num"), ("conj", "conj(x)", "x", "num"), ("exp", "exp(u)", "exp(u)", "num"), ("log", "log(y)", "ln(y)", "num"), ("log2", "log2(y)", "log2(y)", "num"), ("log10", "log10(y)", "log10(y)", "num"),
    ("expm1", "expm1(u)", "exp(u) - 1", "num"), ("log1p", "log1p(y)", "ln(1 + y)", "num"), ("sqrt", "sqrt(y)", "sqrt(y)", "num"), ("square", "square(y)", "y * y", "num"), ("sqr", "sqr(y)", "y * y", "num"), ("reciprocal", "reciprocal(y)", "1 / y", "num"),
    ("sin", "sin(x)", "sin(x)", "num"), ("cos", "cos(x)", "cos(x)", "num"), ("tan", "tan(u)", "tan(u)", "num"), ("arcsin", "arcsin(u)", "asin(u)", "num"), ("asin", "asin(u)", "asin(u)", "num"), ("arccos", "arccos(u)", "acos(u)", "num"), ("acos", "acos(u)", "acos(u)", "num"),
    ("arctan", "arctan(x)", "atan(x)", "num"), ("atan", "atan(x)", "atan(x)", "num"), ("arctan2", "arctan2(x, y)", "atan2(x, y)", "num"), ("atan2", "atan2(x, y)", "atan2(x, y)", "num"), ("hypot", "hypot(u, y)", "sqrt(u * u + y * y)", "num"),
    ("sinh", "sinh(u)", "sinh(u)", "num"), ("cosh", "cosh(u)", "cosh(u)", "num"), ("tanh", "tanh(u)", "tanh(u)", "num"), ("arcsinh", "arcsinh(x)", "asinh(x)", "num"), ("asinh", "asinh(x)", "asinh(x)", "num"), ("arccosh", "arccosh(y + 1)", "acosh(y + 1)", "num"), ("acosh", "acosh(y + 1)", "acosh(y + 1)", "num"), ("arctanh", "arctanh(u)", "atanh(u)", "num"), ("atanh", "atanh(u)", "atanh(u)", "num"),
    ("bitwise_and", "bitwise_and(i, k)", "i & k", "int"), ("bitwise_or", "bitwise_or(i, k)", "i | k", "int"), ("bitwise_xor", "bitwise_xor(i, k)", "xor(i, k)", "int"), ("invert", "invert(i)", "~i", "int"), ("bitwise_not", "~i", "~i", "int"), ("left_shift", "k << 3", "k * 8", "int"), ("right_shift", "i >> 1", "floor(i / 2)", "int"),
    ("greater", "greater(x, y)", "x > y", "bool"), ("greater_equal", "greater_equal(i, j)", "i >= j", "bool"), ("less", "less(x, y)", "x < y", "bool"), ("less_equal", "less_equal(i, j)", "i <= j", "bool"), ("not_equal", "not_equal(i, j)", "i <> j", "bool"), ("equal", "equal(i, j)", "i = j", "bool"),
    ("logical_and", "logical_and(p, q)", "p AND q", "bool"), ("logical_or", "logical_or(p, q)", "p OR q", "bool"), ("logical_xor", "logical_xor(p, q)", "p <> q", "bool"), ("logical_not", "logical_not(p)", "NOT p", "bool"), ("and", "p and q", "p AND q", "bool"), ("or", "p or q", "p OR q", "bool"), ("xor", "p xor q", "p <> q", "bool"), ("not", "not p", "NOT p", "bool"),
    ("maximum", "maximum(x, y)", "greatest(x, y)", "num"), ("minimum", "minimum(x, y)", "least(x, y)", "num"), ("isfinite", "isfinite(y)", "isfinite(y)", "bool"), ("isinf", "isinf(y)", "isinf(y)", "bool"), ("isnan", "isnan(u + 1)", "coalesce(isnan(u + 1), FALSE)", "bool"), ("signbit", "signbit(x)", "x < 0", "bool"),
    ("ldexp", "ldexp(y, k)", "y * pow(2, k)", "num"), ("floor", "floor(x)", "floor(x)", "num"), ("ceil", "ceil(x)", "ceil(x)", "num"), ("isin", "i in {1, 2}", "i IN (1, 2)", "bool"), ("notin", "i not in {1, 2}", "i NOT IN (1, 2)", "bool"),
    ("logaddexp", "logaddexp(u, y)", "ln(exp(u) + exp(y))", "num"), ("logaddexp2", "logaddexp2(u, y)", "log2(pow(2, u) + pow(2, y))", "num"), ("exp2", "exp2(y)", "pow(2, y)", "exp2"), ("deg2rad", "deg2rad(x)", "radians(x)", "num"), ("rad2deg", "rad2deg(u)", "degrees(u)", "num"),
    ("copysign", "copysign(y, x)", "CASE WHEN x IS NULL THEN abs(y) WHEN x < 0 THEN -abs(y) ELSE abs(y) END", "num"), ("nextafter", "nextafter(y, 1000.0) > y", "CASE WHEN y IS NOT NULL THEN TRUE END", "bool"), ("trunc", "trunc(x)", "trunc(x)", "num"),
    ("chained", "-1 < u <= 0.5", "u > -1 AND u <= 0.5", "bool"),
]
for _name, _text, _sql, _kind in _TABLE_ROWS:
    if _kind == "exp2":
        _text, _sql, _kind = "exp2(u)", "pow(2, u)", "num"
    if _name == "logaddexp":
        _text, _sql = "logaddexp(u, x / 10)", "ln(exp(u) + exp(x / 10))"
    if _name == "logaddexp2":
        _text, _sql = "logaddexp2(u, x / 10)", "log2(pow(2, u) + pow(2, x / 10))"
    _plain(_name, _text, _sql, _kind)
