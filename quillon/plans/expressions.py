"""Expressions and predicates of model documents, compiled to columns."""

from __future__ import annotations

import glob
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import formula
from quillon.mcol import INVALID, MISSING, VALID, MCol, literal, propagate
from quillon.operators import windows
from quillon.plans.ir import ModelError, Node, from_xml
from quillon.plans.types import SPARK_TYPES, cast, in_interval, read_type

EXPRESSIONS = ("Constant", "FieldRef", "NormContinuous", "NormDiscrete", "Discretize", "MapValues", "Apply", "Formula", "CastExpression", "Aggregate", "RegularExpression", "CountSubstrings")


@dataclass
class _Change:
    names: list[str]
    change: Callable[[DataFrame], DataFrame]

    def __len__(self) -> int:
        return len(self.names)


@dataclass
class Scope:
    """Names in reach, the macros of defined functions, and the order and grouping of running aggregates."""

    names: dict[str, MCol]
    macros: dict = field(default_factory=dict)
    legacy: bool = False
    order_by: tuple[Column, ...] = ()
    partition_by: tuple[Column, ...] = ()
    last_match: bool = False
    steps: list[dict[str, Column] | _Change] = field(default_factory=list)

    def inner(self, more: Mapping[str, MCol] | None = None) -> Scope:
        return Scope({**self.names, **(more or {})}, self.macros, self.legacy, self.order_by, self.partition_by, self.last_match, self.steps)

    def run(self, names: list[str], change: Callable[[DataFrame], DataFrame]) -> list[Column]:
        """Stages work on the whole frame that adds the named columns."""
        self.steps.append(_Change(names, change))
        return [F.col(n) for n in names]

    def stage(self, *cols: Column) -> list[Column]:
        """Gives expressions that are used more than once a projection of their own, so that their code is planned once."""
        base = sum(map(len, self.steps))
        names = [f"__s{base + k}" for k in range(len(cols))]
        self.steps.append(dict(zip(names, cols, strict=True)))
        return [F.col(n) for n in names]

    def staged(self, col: MCol) -> MCol:
        if col.mask is None:
            return MCol(self.stage(col.value)[0])
        value, mask = self.stage(col.value, col.mask)
        return MCol(value, mask)

    def applied(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.change(df) if isinstance(step, _Change) else df.withColumns(step)
        return df

    def find(self, name: str) -> MCol:
        if name not in self.names:
            raise ModelError(f"unknown field {name!r}")
        return self.names[name]


def child_expression(node: Node) -> Node:
    found = node.first(*EXPRESSIONS)
    if found is None:
        raise ModelError(f"{node.tag} holds no expression")
    return found


def as_missing(col: MCol, text: str | None) -> MCol:
    """mapMissingTo."""
    if text is None or col.mask is None:
        return col
    return MCol(F.when(col.mask == MISSING, F.lit(text).try_cast("double") if _is_number(text) else F.lit(text)).otherwise(col.value), F.when(col.mask == MISSING, VALID).otherwise(col.mask))


def _is_number(text: str) -> bool:
    return bool(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", text))


def _constant(node: Node) -> object:
    kind = node.get("dataType")
    if kind is None:
        return (float(node.text) if re.search(r"[.eE]", node.text) else int(node.text)) if _is_number(node.text) else node.text
    if kind == "integer":
        return int(node.text)
    if kind in ("double", "float"):
        return float(node.text)
    return node.text.lower() in ("1", "true") if kind == "boolean" else node.text


def expression(node: Node, scope: Scope) -> MCol:
    """Compiles one expression element."""
    make = _MAKERS.get(node.tag)
    if make is None:
        raise ModelError(f"no expression: {node.tag}")
    return make(node, scope)


def _make_constant(node: Node, scope: Scope) -> MCol:
    return literal(_constant(node), SPARK_TYPES.get(node.get("dataType") or ""))


def _make_field(node: Node, scope: Scope) -> MCol:
    return as_missing(scope.find(node.need("field")), node.get("mapMissingTo"))


def _make_norm_continuous(node: Node, scope: Scope) -> MCol:
    """Piecewise linear; outside the knots it goes on, is missing or stays at the end."""
    col = scope.find(node.need("field"))
    knots = sorted((n.number("orig"), n.number("norm")) for n in node.all("LinearNorm"))
    if len(knots) < 2:
        raise ModelError("NormContinuous needs two LinearNorms")
    x, outliers = col.value, node.get("outliers", "asIs")

    def line(k: int) -> Column:
        (a, p), (b, q) = knots[k], knots[k + 1]
        return F.lit(p) + (x - a) * ((q - p) / (b - a))

    value = F.when(x < knots[1][0], line(0))
    for k in range(1, len(knots) - 1):
        value = value.when(x < knots[k + 1][0], line(k))
    value = value.otherwise(line(len(knots) - 2))
    state = col.state
    below, above = x < knots[0][0], x > knots[-1][0]
    if outliers == "asExtremeValues":
        value = F.when(below, F.lit(knots[0][1])).when(above, F.lit(knots[-1][1])).otherwise(value)
    elif outliers == "asMissingValues":
        state = F.when((state == VALID) & (below | above), MISSING).otherwise(state)
    return as_missing(MCol(F.when(state == VALID, value), state), node.get("mapMissingTo"))


def _make_norm_discrete(node: Node, scope: Scope) -> MCol:
    col = scope.find(node.need("field"))
    return as_missing(propagate((col.value.cast("string") == node.need("value")).cast("double"), [col]), node.get("mapMissingTo"))


def fan_out_by_value(df: DataFrame, name: str, prefix: str, most: int = 1000) -> DataFrame:
    """One 0/1 column for each distinct value; the number of values is checked against ``most``."""
    values = [r[0] for r in df.select(F.col(name).cast("string")).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ModelError(f"{name} has more than {most} values")
    return df.withColumns({f"{prefix}{v}": (F.col(name).cast("string") == v).cast("double") for v in sorted(values)})


def _make_discretize(node: Node, scope: Scope) -> MCol:
    """First matching bin (or the last, on request); no bin gives the default or INVALID."""
    col = scope.find(node.need("field"))
    bins = []
    for b in node.all("DiscretizeBin"):
        i = b.first("Interval")
        bins.append((in_interval(col.value, i.get("closure", "closedClosed"), i.number("leftMargin"), i.number("rightMargin")), b.need("binValue")))
    kind = SPARK_TYPES.get(node.get("dataType", "string"), "string")
    value: Column | None = None
    for hit, label in reversed(bins) if scope.last_match else bins:
        value = F.when(hit, F.lit(label).cast(kind)) if value is None else value.when(hit, F.lit(label).cast(kind))
    default = node.get("defaultValue")
    value = value.otherwise(F.lit(default).cast(kind)) if default is not None else value
    state = F.when(col.state != VALID, col.state).when(value.isNull(), INVALID).otherwise(VALID)
    return as_missing(MCol(F.when(state == VALID, value), state), node.get("mapMissingTo"))


def inline_rows(node: Node) -> list[dict[str, str]]:
    """Rows of an InlineTable."""
    table = node.first("InlineTable")
    if table is not None:
        return [{c.tag: c.text for c in row.children} for row in table.all("row")]
    located = node.first("TableLocator")
    return external_rows(located) if located is not None else []


def external_rows(located: Node, most: int = 100_000) -> list[dict[str, str]]:
    """Rows of the XML files an Extension of a TableLocator names (a path or a glob); larger tables go through map_values_join."""
    out: list[dict[str, str]] = []
    for e in located.all("Extension"):
        for path in sorted(glob.glob(e.get("value") or e.need("name"))):
            with open(path, encoding="utf-8") as text:
                out += [{c.tag: c.text for c in row.children} for row in from_xml(text.read()).children]
            if len(out) > most:
                raise ModelError(f"the located table has more than {most} rows")
    return out


def _make_map_values(node: Node, scope: Scope) -> MCol:
    """Lookup over a literal map keyed by all columns; any missing key takes mapMissingTo, no row the default."""
    pairs = [(p.need("field"), p.need("column")) for p in node.all("FieldColumnPair")]
    keys = [scope.find(f) for f, _ in pairs]
    out, kind = node.need("outputColumn"), SPARK_TYPES.get(node.get("dataType", "string"), "string")
    entries: dict[str, str] = {}
    for row in inline_rows(node):
        k = "\x1f".join(row.get(c, "") for _, c in pairs)
        if scope.last_match or k not in entries:
            entries[k] = row[out]
    key = F.concat_ws("\x1f", *(k.value.cast("string") for k in keys))
    value = F.try_element_at(F.create_map(*[F.lit(v) for kv in entries.items() for v in kv]), key) if entries else F.lit(None).cast("string")
    default = node.get("defaultValue")
    value = F.coalesce(value, F.lit(default)) if default is not None else value
    value = value.cast(kind)
    gone = reduce(lambda a, b: a | b, [k.state == MISSING for k in keys])
    bad = reduce(lambda a, b: a | b, [k.state == INVALID for k in keys])
    state = F.when(bad, INVALID).when(gone, MISSING).when(value.isNull(), INVALID).otherwise(VALID)
    return as_missing(MCol(F.when(state == VALID, value), state), node.get("mapMissingTo"))


def map_values_join(df: DataFrame, rows: DataFrame, pairs: Mapping[str, str], out: str, default: object = None, broadcast_rows: int = 100_000) -> DataFrame:
    """Lookup in a large table: left join, broadcast only if it has at most ``broadcast_rows`` rows. The first row of a key, by value, wins."""
    small = rows.groupBy(*pairs.values()).agg(F.min(out).alias("__found"))
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        small = F.broadcast(small)
    renamed = small.select(*[F.col(c).alias(f"__k_{f}") for f, c in pairs.items()], "__found")
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"__k_{f}") for f in pairs])
    found = F.col("__found") if default is None else F.coalesce(F.col("__found"), F.lit(default))
    return df.join(renamed, cond, "left").withColumn(out, found).drop("__found", *[f"__k_{f}" for f in pairs])


def _make_apply(node: Node, scope: Scope) -> MCol:
    args = [c for c in node.children if c.tag in EXPRESSIONS]
    built = [expression(c, scope) for c in args]
    constants = [_constant(c) if c.tag == "Constant" else None for c in args]
    try:
        out = formula.call(node.need("function"), built, constants, scope.legacy, scope.macros)
    except formula.FormulaError as err:
        raise ModelError(str(err)) from err
    if node.get("invalidValueTreatment") == "asMissing" and out.mask is not None:
        out = MCol(out.value, F.when(out.mask == INVALID, MISSING).otherwise(out.mask))
    return as_missing(out, node.get("mapMissingTo"))


def _make_formula(node: Node, scope: Scope) -> MCol:
    return formula.compile_masked(formula.parse(node.text), scope.names, scope.legacy, scope.macros)


def _make_cast(node: Node, scope: Scope) -> MCol:
    node = Node(node.tag, {"name": "cast", **node.attrs}, node.children, node.text)
    return cast(expression(child_expression(node), scope), read_type(node))


def _make_aggregate(node: Node, scope: Scope) -> MCol:
    """Running aggregate over the scope's order: row i sees rows up to i. A groupField restricts to the row's own group."""
    if not scope.order_by:
        raise ModelError("Aggregate needs an order of rows")
    col = scope.find(node.need("field"))
    ok = col.state == VALID
    where = node.get("sqlWhere")
    if where:
        hit = formula.compile_masked(formula.parse(where), scope.names, scope.legacy, scope.macros)
        ok = ok & F.coalesce(hit.value, F.lit(False))
    parts = [F.col(c) if isinstance(c, str) else c for c in scope.partition_by]
    if node.get("groupField"):
        parts.append(scope.find(node.need("groupField")).value)
    x, kind = F.when(ok, col.value), node.need("function")
    order = [F.col(c) if isinstance(c, str) else c for c in scope.order_by]
    if kind == "multiset":
        frame = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return MCol(F.sort_array(F.collect_list(x).over(frame)))
    if kind not in ("count", "sum", "average", "min", "max"):
        raise ModelError(f"unknown aggregate {kind!r}")
    # By pieces of a group, so that neither all rows nor a large group meet in one task.
    staged = scope.stage(x, *parts, *order)
    base = sum(map(len, scope.steps))
    names = [f"__s{base - len(staged) + k}" for k in range(len(staged))]
    by, ordered, out = names[1 : 1 + len(parts)], names[1 + len(parts) :], f"__s{base}"
    (value,) = scope.run([out], lambda df: windows.running(df, F.col(names[0]), kind, by, ordered, out))
    return MCol(value) if kind in ("count", "sum") else MCol(value, F.when(value.isNotNull(), VALID).otherwise(INVALID))


def _make_regex(node: Node, scope: Scope) -> MCol:
    """Match at the start and expand the replacement's groups (\\1 …); no match is MISSING."""
    col = scope.find(node.need("field"))
    pattern = node.need("pattern")
    if "i" in node.get("flags", "").lower():
        pattern = f"(?i){pattern}"
    pieces = []
    for m in re.finditer(r"\\g<(\d+)>|\\(\d)|([^\\]+|\\.)", node.need("replacement")):
        group = m[1] or m[2]
        pieces.append(F.regexp_extract(col.value, f"^(?:{pattern})", int(group)) if group else F.lit(m[3]))
    hit = F.regexp_like(col.value, F.lit(f"^(?:{pattern})"))
    state = F.when(col.state != VALID, col.state).when(hit, VALID).otherwise(MISSING)
    return as_missing(MCol(F.when(state == VALID, F.concat(*pieces)), state), node.get("mapMissingTo"))


def _make_count_substrings(node: Node, scope: Scope) -> MCol:
    """Σ weight × number of occurrences, over delimited n-grams or over plain substrings."""
    col = scope.find(node.need("field"))
    text = col.value
    if node.get("caseSensitive", "1") in ("0", "false"):
        text = F.lower(text)
    if node.get("ignore"):
        text = F.regexp_replace(text, node.need("ignore"), "")
    if node.get("foldWhitespace", "0") in ("1", "true"):
        text = F.regexp_replace(F.trim(text), r"\s+", " ")
    n, delimiter = int(node.get("nGramGroups", "1")), node.get("delimiter")
    total = F.lit(0.0)
    for sub in node.all("Substring"):
        want = sub.need("value").lower() if node.get("caseSensitive", "1") in ("0", "false") else sub.need("value")
        if delimiter:
            words = F.split(text, re.escape(delimiter))
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i, words=words: F.array_join(F.slice(words, i, n), delimiter))
            count = F.size(F.filter(grams, lambda g, want=want: g == want))
        else:
            count = (F.length(text) - F.length(F.replace(text, F.lit(want), F.lit("")))) / len(want)
        total = total + count * (sub.number("weight", 1.0) or 0.0)
    return as_missing(propagate(total, [col]), node.get("mapMissingTo"))


_MAKERS = {
    "Constant": _make_constant, "FieldRef": _make_field, "NormContinuous": _make_norm_continuous, "NormDiscrete": _make_norm_discrete, "Discretize": _make_discretize, "MapValues": _make_map_values, "Apply": _make_apply,
    "Formula": _make_formula, "CastExpression": _make_cast, "Aggregate": _make_aggregate, "RegularExpression": _make_regex, "CountSubstrings": _make_count_substrings,
}


def define_functions(node: Node, scope: Scope) -> None:
    """DefineFunction elements become macros, expanded at compile time."""
    for d in node.all("DefineFunction"):
        params = [p.need("name") for p in d.all("ParameterField")]
        body = child_expression(d)

        def macro(args: list[MCol], params: list[str] = params, body: Node = body) -> MCol:
            if len(args) != len(params):
                raise ModelError(f"{len(params)} arguments expected")
            return expression(body, Scope(dict(zip(params, args, strict=True)), scope.macros, scope.legacy, scope.order_by, scope.partition_by, scope.last_match, scope.steps))

        scope.macros[d.need("name")] = macro


def derived_fields(node: Node, scope: Scope) -> list[str]:
    """DerivedFields in order; each sees those before it. Returns their names."""
    made = []
    for d in node.all("DerivedField"):
        name = d.need("name")
        if name in made:
            raise ModelError(f"field {name!r} is defined twice")
        col = expression(child_expression(d), scope)
        scope.names[name] = scope.staged(cast(scope.staged(col), read_type(d)) if d.get("dataType") else col)
        made.append(name)
    return made


# Predicates are SQL booleans: NULL is UNKNOWN.


def predicate(node: Node, scope: Scope) -> Column:
    if node.tag == "True":
        return F.lit(True)
    if node.tag == "False":
        return F.lit(False)
    if node.tag == "SimplePredicate":
        return _simple(node, scope)
    if node.tag == "SimpleSetPredicate":
        col = scope.find(node.need("field"))
        array = node.first("Array")
        values = array_values(array)
        hit = col.value.cast("string").isin(values) if array.get("type") == "string" else col.value.isin([float(v) for v in values])
        hit = hit if node.need("booleanOperator") == "isIn" else ~hit
        return F.coalesce(hit, F.lit(False)) if scope.legacy else hit
    if node.tag == "CompoundPredicate":
        parts = [predicate(c, scope) for c in node.children if c.tag in ("SimplePredicate", "SimpleSetPredicate", "CompoundPredicate", "True", "False")]
        op = node.need("booleanOperator")
        if op == "surrogate":
            return F.coalesce(*parts)
        if op not in ("and", "or", "xor"):
            raise ModelError(f"unknown booleanOperator {op!r}")
        return reduce({"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[op], parts)
    raise ModelError(f"no predicate: {node.tag}")


def array_values(array: Node) -> list[str]:
    """Blank-separated values; quoted ones may hold blanks."""
    return [re.sub(r"\\(.)", r"\1", q) if q else w for q, w in re.findall(r'"((?:[^"\\]|\\.)*)"|(\S+)', array.text)]


def _simple(node: Node, scope: Scope) -> Column:
    col, op = scope.find(node.need("field")), node.need("operator")
    if op == "isMissing":
        return F.when(col.state != INVALID, col.state == MISSING)
    if op == "isNotMissing":
        return F.when(col.state != INVALID, col.state != MISSING)
    text = node.need("value")
    number = _is_number(text)
    x, y = (col.value.try_cast("double"), F.lit(float(text))) if number else (col.value.cast("string"), F.lit(text))
    if op in ("equal", "notEqual") and number:
        same = F.coalesce(x == y, col.value.cast("string") == text)
        return same if op == "equal" else ~same
    ops = {"equal": x == y, "notEqual": x != y, "lessThan": x < y, "lessOrEqual": x <= y, "greaterThan": x > y, "greaterOrEqual": x >= y}
    if op not in ops:
        raise ModelError(f"unknown operator {op!r}")
    return ops[op]
