"""Model scorers, compiled to columns: one projection for a whole model, windows only where rows depend on others.

Each scorer returns its features as masked columns; "" is the predicted value.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.mcol import INVALID, MISSING, VALID, MCol, source
from quillon.operators import windows
from quillon.plans.expressions import EXPRESSIONS, Scope, array_values, as_missing, child_expression, define_functions, derived_fields, expression, predicate
from quillon.plans.ir import MODELS, PREDICATES, UNSCORED, ModelError, Node
from quillon.plans.types import cast, mining_field, read_type, treats

Features = dict[str, MCol]
#: Trees with more nodes than this are walked in Arrow batches, not compiled into one CASE.
WIDE_TREE = 150


def _null_state(value: Column, otherwise: int = INVALID) -> MCol:
    return MCol(value, F.when(value.isNull(), otherwise).otherwise(VALID))


# Baseline statistics.


def log_density(node: Node, x: Column) -> Column:
    """Log density of a distribution element."""
    if node.tag == "GaussianDistribution":
        m, v = node.number("mean"), node.number("variance")
        return -((x - m) * (x - m)) / (2 * v) - 0.5 * math.log(2 * math.pi * v)
    if node.tag == "PoissonDistribution":
        m = node.number("mean")
        return x * math.log(m) - m - special.log_factorial(x)
    if node.tag == "UniformDistribution":
        low, high = node.number("lower"), node.number("upper")
        return F.when(x.between(low, high), F.lit(-math.log(high - low))).otherwise(F.lit(float("-inf")))
    if node.tag == "ExponentialDistribution":
        m = node.number("mean")
        return F.when(x >= 0, -x / m - math.log(m)).otherwise(F.lit(float("-inf")))
    raise ModelError(f"no density: {node.tag}")


def cumulative(node: Node, x: Column) -> Column:
    if node.tag == "GaussianDistribution":
        return 0.5 + 0.5 * special.erf((x - node.number("mean")) / math.sqrt(2 * node.number("variance")))
    if node.tag == "UniformDistribution":
        low, high = node.number("lower"), node.number("upper")
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    if node.tag == "ExponentialDistribution":
        return F.when(x > 0, 1 - F.exp(-x / node.number("mean"))).otherwise(0.0)
    if node.tag == "PoissonDistribution":
        return 1 - special.chi_square_cdf(F.lit(2.0 * node.number("mean")), 2 * (F.floor(x) + 1))
    raise ModelError(f"no cumulative: {node.tag}")


_DISTRIBUTIONS = ("GaussianDistribution", "PoissonDistribution", "UniformDistribution", "ExponentialDistribution", "AnyDistribution")


def _baseline(model: Node, scope: Scope) -> Features:
    test = model.first("TestDistributions")
    statistic, col = test.need("testStatistic"), scope.find(test.need("field"))
    x = col.value.cast("double")
    base_holder = test.first("Baseline")
    base = base_holder.first(*_DISTRIBUTIONS)
    if statistic == "zValue":
        if base.tag in ("UniformDistribution", "ExponentialDistribution", "PoissonDistribution") and base.get("variance") is None and scope.legacy:
            cdf = cumulative(base, x)
            z = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), math.sqrt(2) * special.erf_inverse(2 * cdf - 1)))
        else:
            mean = base.number("mean")
            variance = base.number("variance", mean if base.tag == "PoissonDistribution" else None)
            z = F.try_divide(x - mean, F.lit(math.sqrt(variance)) if variance and variance > 0 else F.lit(0.0))
        (z,) = scope.stage(z)
        state = F.when(col.state != VALID, col.state).when(z.isNull(), INVALID).otherwise(VALID)
        p = 1 - F.abs(special.erf(z / math.sqrt(2)))
        return {"": MCol(F.when(state == VALID, z), state), "pValue": MCol(F.when(state == VALID, p), state)}
    if not scope.order_by:
        raise ModelError(f"{statistic} needs an order of rows")
    w = W.partitionBy(*scope.partition_by).orderBy(*scope.order_by)
    ok = F.when(col.state == VALID, x)
    if statistic == "CUSUM":
        alternate = test.first("Alternate").first(*_DISTRIBUTIONS)
        step = log_density(alternate, ok) - log_density(base, ok)
        reset, size = test.number("resetValue", 0.0), test.number("windowSize")
        if size:
            value = F.aggregate(F.collect_list(step).over(w.rowsBetween(-(int(size) - 1), 0)), F.lit(0.0), lambda a, v: F.greatest(F.lit(reset), a + v))
        else:
            return {"": MCol(F.lit(0.0)), "__cusum": (step, reset, scope.partition_by, scope.order_by)}  # type: ignore[dict-item]
        return {"": MCol(value)}
    if statistic in ("GLR", "glr"):
        size = int(test.number("windowSize", 100))
        values = F.reverse(F.collect_list(ok).over(w.rowsBetween(-(size - 1), 0)))
        mean, variance = base.number("mean"), base.number("variance")
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(float("-inf")).alias("b"))

        def fold(a: Column, v: Column) -> Column:
            s, n = a["s"] + v, a["n"] + 1
            f = F.pow(s - n * mean, F.lit(2.0)) / n / (2 * variance) if base.tag == "GaussianDistribution" else F.when(s > 0, F.ln(s / n) * s).otherwise(0.0) - s * math.log(mean) + n * mean - s
            return F.struct(s.alias("s"), n.alias("n"), F.greatest(a["b"], f).alias("b"))

        return {"": _null_state(F.nullif(F.aggregate(values, zero, fold)["b"], F.lit(float("-inf"))))}
    raise ModelError(f"testStatistic {statistic!r} is scored by the functions of operators.windows")


# Trees.


def _tree(model: Node, scope: Scope) -> Features:
    strategy = model.get("missingValueStrategy", "none")
    if strategy in ("weightedConfidence", "aggregateNodes"):
        raise ModelError(f"missingValueStrategy {strategy} is not supported")
    keep_last = model.get("noTrueChildStrategy", "returnNullPrediction") == "returnLastPrediction"
    penalty = model.number("missingValuePenalty", 1.0)
    root = model.first("Node")
    nodes: list[Node] = []

    def number(n: Node) -> None:
        nodes.append(n)
        for c in n.all("Node"):
            number(c)

    number(root)
    places = {id(n): k for k, n in enumerate(nodes)}

    def walk(n: Node, unknowns: int) -> Column:
        kids = n.all("Node")
        here = F.struct(F.lit(places[id(n)]).alias("k"), F.lit(unknowns).alias("u"))
        nothing = F.lit(None).cast("struct<k:int,u:int>")
        if not kids:
            return here
        out = None
        for kid in kids:
            p = predicate(kid.first(*PREDICATES), scope)
            deeper = walk(kid, unknowns)
            out = F.when(p, deeper) if out is None else out.when(p, deeper)
            if strategy == "lastPrediction":
                out = out.when(p.isNull(), here)
            elif strategy == "nullPrediction":
                out = out.when(p.isNull(), nothing)
            elif strategy == "defaultChild":
                default = next((k for k in kids if k.get("id") == n.get("defaultChild")), None)
                out = out.when(p.isNull(), walk(default, unknowns + 1) if default is not None else nothing)
        return out.otherwise(here if keep_last else nothing)

    top = predicate(root.first(*PREDICATES), scope)
    place = F.when(F.coalesce(top, F.lit(False)), _wide_walk(nodes, places, scope, strategy, keep_last) if len(nodes) > WIDE_TREE else walk(root, 0))
    (place,) = scope.stage(place)
    spot, unknowns = place["k"], place["u"]

    def pick(values: list, kind: str) -> Column:
        return F.try_element_at(F.array(*[F.lit(v).cast(kind) for v in values]), spot + 1)

    def spread(n: Node) -> list[tuple[str, float, float | None]]:
        return [(s.need("value"), s.number("recordCount", 0.0), s.number("confidence")) for s in n.all("ScoreDistribution")]

    scores, confidences, probabilities = [], [], []
    for n in nodes:
        counts = spread(n)
        best = max(counts, key=lambda c: c[1], default=None)
        total = sum(c[1] for c in counts)
        scores.append(n.get("score") or (best[0] if best else None))
        mine = next((c for c in counts if c[0] == scores[-1]), best)
        share = mine[1] / total if mine and total else None
        confidences.append(mine[2] if mine and mine[2] is not None else share)
        probabilities.append(share)
    regression = model.get("functionName") == "regression"
    score = pick([float(s) if s is not None else None for s in scores], "double") if regression else pick(scores, "string")
    for n in nodes:
        inner = n.first("Regression")
        if inner is not None:
            score = F.when(spot == places[id(n)], regression_value(inner.first("RegressionTable"), scope).value).otherwise(score)
    labels = sorted({c[0] for n in nodes for c in spread(n)})
    out = {"": _null_state(score, MISSING), "entityId": _null_state(pick([n.get("id", str(k)) for k, n in enumerate(nodes)], "string"), MISSING), "entity": _null_state(pick([n.get("id", str(k)) for k, n in enumerate(nodes)], "string"), MISSING)}
    out["confidence"] = _null_state(pick(confidences, "double") * F.pow(F.lit(float(penalty)), unknowns.cast("double")), MISSING)
    out["probability"] = _null_state(pick(probabilities, "double"), MISSING)
    for label in labels:
        shares = [next((c[1] / max(1e-300, sum(x[1] for x in spread(n))) for c in spread(n) if c[0] == label), 0.0 if spread(n) else None) for n in nodes]
        out[f"probability:{label}"] = _null_state(pick(shares, "double"), MISSING)
    return out


def _wide_walk(nodes: list[Node], places: dict[int, int], scope: Scope, strategy: str, keep_last: bool) -> Column:
    """Walks a large tree over Arrow batches: predicates are evaluated on the rows that reach them."""
    fields = sorted({p.need("field") for n in nodes for p in n.walk() if p.get("field") and p.tag in PREDICATES})
    plan = [(n.first(*PREDICATES), [places[id(c)] for c in n.all("Node")], next((places[id(c)] for c in n.all("Node") if c.get("id") == n.get("defaultChild")), None)) for n in nodes]

    def truth(p: Node, frame: pd.DataFrame) -> np.ndarray:
        """1, 0 or NaN for unknown."""
        if p.tag in ("True", "False"):
            return np.full(len(frame), 1.0 if p.tag == "True" else 0.0)
        if p.tag == "CompoundPredicate":
            parts = [truth(c, frame) for c in p.children if c.tag in PREDICATES]
            op = p.need("booleanOperator")
            if op == "surrogate":
                return reduce(lambda a, b: np.where(np.isnan(a), b, a), parts)
            if op == "xor":
                return reduce(lambda a, b: np.where(np.isnan(a) | np.isnan(b), np.nan, (a != b).astype(float)), parts)
            decided = 0.0 if op == "and" else 1.0
            some = reduce(lambda a, b: a | b, [q == decided for q in parts])
            unknown = reduce(lambda a, b: a | b, [np.isnan(q) for q in parts])
            return np.where(some, decided, np.where(unknown, np.nan, 1 - decided))
        col = frame[p.need("field")]
        gone = col.isna().to_numpy()
        if p.tag == "SimpleSetPredicate":
            hit = col.astype(str).isin(array_values(p.first("Array"))).to_numpy()
            hit = hit if p.need("booleanOperator") == "isIn" else ~hit
        else:
            op = p.need("operator")
            if op in ("isMissing", "isNotMissing"):
                return (gone if op == "isMissing" else ~gone).astype(float)
            try:
                x, y = pd.to_numeric(col, errors="coerce").to_numpy(float), float(p.need("value"))
            except ValueError:
                x, y = col.astype(str).to_numpy(), p.need("value")
            hit = {"equal": lambda: x == y, "notEqual": lambda: x != y, "lessThan": lambda: x < y, "lessOrEqual": lambda: x <= y, "greaterThan": lambda: x > y, "greaterOrEqual": lambda: x >= y}[op]()
        return np.where(gone, np.nan, np.asarray(hit, float))

    @F.pandas_udf("struct<k:int,u:int>")
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k, u = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        null = np.zeros(len(frame), bool)
        todo = [(0, np.arange(len(frame)))]
        while todo:
            at, rows = todo.pop()
            _, kids, default = plan[at]
            k[rows] = at
            for kid in kids:
                if not len(rows):
                    break
                t = truth(plan[kid][0], frame.iloc[rows])
                todo.append((kid, rows[t == 1]))
                lost = rows[np.isnan(t)]
                if strategy == "nullPrediction":
                    null[lost] = True
                elif strategy == "defaultChild" and len(lost):
                    u[lost] += 1
                    if default is None:
                        null[lost] = True
                    else:
                        todo.append((default, lost))
                rows = rows[t == 0] if strategy != "none" else rows[t != 1]
            if kids and not keep_last:
                null[rows] = True
        return pd.DataFrame({"k": pd.Series(k).where(~null).astype("Int32"), "u": u.astype(np.int32)})

    return run(F.struct(*[scope.find(f).value.alias(f) for f in fields]))


# Regression.


def regression_value(table: Node, scope: Scope) -> MCol:
    """intercept + Σ coefficient·xᵉ + Σ coefficient·[x = v] + Σ coefficient·Πx."""
    total, masks = F.lit(table.number("intercept", 0.0)), []
    for p in table.children:
        coefficient = p.number("coefficient", 0.0)
        if p.tag == "NumericPredictor":
            col = scope.find(p.need("name"))
            exponent = p.number("exponent", 1.0)
            x = col.value.cast("double")
            total = total + coefficient * (x if exponent == 1 else F.pow(x, F.lit(exponent)))
            masks.append(col)
        elif p.tag == "CategoricalPredictor":
            col = scope.find(p.need("name"))
            total = total + coefficient * (col.value.cast("string") == p.need("value")).cast("double")
            masks.append(col)
        elif p.tag == "PredictorTerm":
            cols = [scope.find(f.need("field")) for f in p.all("FieldRef")]
            total = total + coefficient * reduce(lambda a, b: a * b, [c.value.cast("double") for c in cols])
            masks += cols
        elif p.tag == "X-PredictorTerm":
            raise ModelError("expressions in model text are not evaluated; define a Formula field instead")
    live = [c.mask for c in masks if c.mask is not None]
    if not live:
        return MCol(total)
    state = F.greatest(*live) if len(live) > 1 else live[0]
    return MCol(F.when(state == VALID, total), state)


def _normal_cdf(y: Column) -> Column:
    return 0.5 + 0.5 * special.erf(y / math.sqrt(2))


#: Inverse links of single tables.
_LINKS = {
    "none": lambda y: y, "logit": lambda y: 1 / (1 + F.exp(-y)), "softmax": lambda y: 1 / (1 + F.exp(-y)), "exp": F.exp, "probit": _normal_cdf,
    "loglog": lambda y: F.exp(-F.exp(-y)), "cloglog": lambda y: 1 - F.exp(-F.exp(y)), "cauchit": lambda y: 0.5 + F.atan(y) / math.pi, "simplemax": lambda y: y,
}


def _regression(model: Node, scope: Scope) -> Features:
    tables = model.all("RegressionTable")
    norm = model.get("normalizationMethod", "none")
    if norm not in _LINKS:
        raise ModelError(f"unknown normalizationMethod {norm!r}")
    if model.get("functionName", "regression") == "regression":
        y = regression_value(tables[0], scope)
        return {"": MCol(_LINKS[norm](y.value), y.mask)}
    if len(tables) < 2:
        raise ModelError("classification needs two regression tables")
    ys = [regression_value(t, scope) for t in tables]
    names = [t.need("targetCategory") for t in tables]
    live = [y.mask for y in ys if y.mask is not None]
    state = (F.greatest(*live) if len(live) > 1 else live[0]) if live else F.lit(VALID)
    values = scope.stage(*(y.value for y in ys))
    ordinal = any(f.get("usageType") in ("predicted", "target") and f.get("optype") == "ordinal" for f in (model.first("MiningSchema") or Node("")).all("MiningField"))
    if ordinal and norm in ("logit", "probit", "loglog", "cloglog", "cauchit"):
        up = [_LINKS[norm](v) for v in values[:-1]]
        probs = [up[0], *(b - a for a, b in zip(up, up[1:], strict=False)), 1 - up[-1]]
    elif norm == "softmax":
        top = F.greatest(*values)
        parts = [F.exp(v - top) for v in values]
        probs = [F.try_divide(p, reduce(lambda a, b: a + b, parts)) for p in parts]
    elif norm == "simplemax":
        probs = [F.try_divide(v, reduce(lambda a, b: a + b, values)) for v in values]
    elif norm == "none" or norm == "exp":
        probs = [_LINKS[norm](v) for v in values]
    else:
        first = [_LINKS[norm](v) for v in values[:-1]]
        probs = [*first, 1 - reduce(lambda a, b: a + b, first)]
    return _classes(scope, names, probs, state)


def _classes(scope: Scope, names: list[str], scores: list[Column], state: Column) -> Features:
    *scores, state = scope.stage(*scores, state)
    best = F.array_max(F.array(*[F.struct(F.coalesce(p, F.lit(float("-inf"))).alias("p"), F.lit(-k).alias("k")) for k, p in enumerate(scores)]))
    (best,) = scope.stage(best)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), 1 - best["k"])
    ok = state == VALID
    out = {"": MCol(F.when(ok, label), state), "probability": MCol(F.when(ok, best["p"]), state)}
    return out | {f"probability:{n}": MCol(F.when(ok, p), state) for n, p in zip(names, scores, strict=True)}


# Naive Bayes.


def _naive_bayes(model: Node, scope: Scope) -> Features:
    """Prior counts × Π (pair / class total of the input, or the threshold for none); missing inputs are skipped, invalid ones spoil the row. Products are sums of logs."""
    threshold = model.number("threshold", 0.0)
    counts = {t.need("value"): t.number("count") for t in model.first("BayesOutput").first("TargetValueCounts").all("TargetValueCount")}
    names = list(counts)
    logs = [F.lit(math.log(counts[n]) if counts[n] > 0 else float("-inf")) for n in names]
    invalid = F.lit(False)
    for i in model.first("BayesInputs").all("BayesInput"):
        derived = i.first("DerivedField")
        col = expression(child_expression(derived), scope) if derived is not None else scope.find(i.need("fieldName"))
        pairs = {p.need("value"): {t.need("value"): t.number("count") for t in p.first("TargetValueCounts").all("TargetValueCount")} for p in i.all("PairCounts")}
        key = col.value.cast("string")
        for k, n in enumerate(names):
            total = sum(c.get(n, 0.0) for c in pairs.values())
            table = {v: math.log(c[n] / total) for v, c in pairs.items() if c.get(n, 0.0) > 0}
            miss = F.lit(math.log(threshold) if threshold > 0 else float("-inf"))
            found = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), miss) if table else miss
            logs[k] = logs[k] + F.when(col.state == VALID, found).otherwise(0.0)
        invalid = invalid | (col.state == INVALID)
    logs = scope.stage(*logs)
    top = F.greatest(*logs)
    parts = [F.when(top == float("-inf"), 0.0).otherwise(F.exp(g - top)) for g in logs]
    parts = scope.stage(*parts)
    total = reduce(lambda a, b: a + b, parts)
    probs = [F.when(total > 0, p / total).otherwise(0.0) for p in parts]
    return _classes(scope, names, probs, F.when(invalid, INVALID).otherwise(VALID))


# Clustering.


def _clustering(model: Node, scope: Scope, reference_compat: bool = False) -> Features:
    measure = model.first("ComparisonMeasure")
    similar = measure.get("kind", "distance") == "similarity"
    metric = next(c for c in measure.children if c.tag != "Extension")
    fields = [f for f in model.all("ClusteringField") if f.get("isCenterField", "true") in ("true", "1")]
    cols = [scope.find(f.need("field")) for f in fields]
    weights = [f.number("fieldWeight", 1.0) for f in fields]
    scales = [f.number("similarityScale", 1.0) for f in fields]
    functions = [f.get("compareFunction", measure.get("compareFunction", "absDiff")) for f in fields]
    mv = model.first("MissingValueWeights")
    miss = [float(v) for v in array_values(mv.first("Array"))] if mv is not None else [1.0] * len(fields)
    clusters = model.all("Cluster")
    some_gone = [c.state != VALID for c in cols]
    known = reduce(lambda a, b: a + b, [F.when(g, 0.0).otherwise(q) for g, q in zip(some_gone, miss, strict=True)])
    adjust = F.try_divide(F.lit(sum(miss)), known)

    def compare(k: int, center: float) -> Column:
        x = cols[k].value.cast("double")
        f = functions[k]
        if f == "absDiff":
            return F.abs(x - center)
        if f == "gaussSim":
            return F.exp(-math.log(2) * F.pow((x - center) / scales[k], F.lit(2.0)))
        if f == "delta":
            return F.when(x == center, 0.0).otherwise(1.0)
        if f == "equal":
            return F.when(x == center, 1.0).otherwise(0.0)
        if f == "table":
            rows = [[float(v) for v in array_values(a)] for a in fields[k].first("Comparisons").first("Matrix").all("Array")]
            row = F.array(*[F.lit(r[int(center)]) for r in rows])
            return F.try_element_at(row, (x + 1).cast("int"))
        raise ModelError(f"unknown compareFunction {f!r}")

    def distance(center: list[float]) -> Column:
        terms = [F.when(~g, compare(k, c)) for k, (g, c) in enumerate(zip(some_gone, center, strict=True))]
        add = lambda p: reduce(lambda a, b: a + b, [F.coalesce(p(t) * w, F.lit(0.0)) for t, w in zip(terms, weights, strict=True)])
        tag = metric.tag
        if tag == "squaredEuclidean":
            return add(lambda t: t * t) * adjust
        if tag == "euclidean":
            return F.sqrt(add(lambda t: t * t) * adjust)
        if tag == "cityBlock":
            return add(lambda t: t) * adjust
        if tag == "chebychev":
            parts = [F.coalesce(t * w, F.lit(0.0)) for t, w in zip(terms, weights, strict=True)]
            return (F.greatest(*parts) if len(parts) > 1 else parts[0]) * adjust
        if tag == "minkowski":
            p = metric.number("p-parameter", metric.number("p", 2.0))
            return F.pow(add(lambda t: F.pow(t, F.lit(p))) * adjust, F.lit(1 / p))
        xs = [c.value.cast("double") for c in cols]
        both = lambda a, b: reduce(lambda p, q: p + q, [((x == a) & F.lit(c == b)).cast("double") for x, c in zip(xs, center, strict=True)])
        a11, a10, a01, a00 = both(1.0, 1.0), both(1.0, 0.0), both(0.0, 1.0), both(0.0, 0.0)
        if tag == "simpleMatching":
            return F.try_divide(a11 + a00, a11 + a10 + a01 + a00)
        if tag == "jaccard":
            return F.try_divide(a11, a11 + a10 + a01)
        if tag == "tanimoto":
            return F.try_divide(a11 + a00, a11 + 2 * (a10 + a01) + a00)
        if tag == "binarySimilarity":
            n = lambda s: metric.number(s)
            top = n("c11-parameter") * a11 + n("c10-parameter") * a10 + n("c01-parameter") * a01 + n("c00-parameter") * a00
            low = n("d11-parameter") * a11 + n("d10-parameter") * a10 + n("d01-parameter") * a01 + n("d00-parameter") * a00
            return F.try_divide(top, low)
        raise ModelError(f"unknown metric {tag!r}")

    centers = [[float(v) for v in array_values(c.first("Array"))] for c in clusters]
    ids = [c.get("id", c.get("name", str(k + 1))) for k, c in enumerate(clusters)]
    values = scope.stage(*(distance(c) for c in centers))
    sign = -1.0 if similar and not reference_compat else 1.0
    best = F.array_min(F.array(*[F.struct((v * sign).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(values)]))
    (best,) = scope.stage(best)
    invalid = reduce(lambda a, b: a | b, [c.state == INVALID for c in cols])
    (state,) = scope.stage(F.when(invalid | (known <= 0) | best["d"].isNull(), INVALID).otherwise(VALID))
    name = F.element_at(F.array(*[F.lit(i) for i in ids]), best["k"] + 1)
    ok = state == VALID
    out = {"": MCol(F.when(ok, name), state)}
    out |= dict.fromkeys(("entity", "clusterId", "entityId"), MCol(F.when(ok, name), state))
    out |= dict.fromkeys(("clusterAffinity", "affinity"), MCol(F.when(ok, best["d"] * sign), state))
    out["predictedDisplayValue"] = MCol(F.when(ok, F.element_at(F.array(*[F.lit(c.get("name", i)) for c, i in zip(clusters, ids, strict=True)]), best["k"] + 1)), state)
    return out | {f"all.{i}": MCol(F.when(ok, v), state) for i, v in zip(ids, values, strict=True)}


# Rule sets.


def _rules(model: Node, scope: Scope) -> Features:
    rule_set = model.first("RuleSet")
    criterion = rule_set.first("RuleSelectionMethod").need("criterion")
    flat: list[tuple[Column, Node]] = []

    def collect(node: Node, given: Column | None) -> None:
        for r in node.all("SimpleRule", "CompoundRule"):
            p = F.coalesce(predicate(r.first(*PREDICATES), scope), F.lit(False))
            p = p if given is None else given & p
            if r.tag == "SimpleRule":
                flat.append((p, r))
            else:
                collect(r, p)

    collect(rule_set, None)
    flat = list(zip(scope.stage(*(p for p, _ in flat)), [r for _, r in flat], strict=True))
    kind = "struct<score:string,weight:double,id:string>"
    made = [F.when(p, F.struct(F.lit(r.need("score")).alias("score"), F.lit(r.number("weight", 1.0)).alias("weight"), F.lit(r.get("id", f"Untitled-{k + 1}")).alias("id"))) for k, (p, r) in enumerate(flat)]
    default = F.when(F.lit(rule_set.get("defaultScore") is not None), F.struct(F.lit(rule_set.get("defaultScore")).alias("score"), F.lit(rule_set.number("defaultConfidence")).cast("double").alias("weight"), F.lit(None).cast("string").alias("id"))).cast(kind)
    hits = F.array_compact(F.array(*made))
    if criterion == "firstHit":
        chosen = F.coalesce(*made, default)
    elif criterion == "weightedMax":
        first = F.lit(None).cast(kind)
        chosen = F.coalesce(F.aggregate(hits, first, lambda a, r: F.when(a.isNull() | (r["weight"] > a["weight"]), r).otherwise(a)), default)
    elif criterion == "weightedSum":
        scores = list(dict.fromkeys(r.need("score") for _, r in flat))
        sums = [F.struct(reduce(lambda a, b: a + b, [F.when(p, r.number("weight", 1.0)).otherwise(0.0) for p, r in flat if r.need("score") == s]).alias("w"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(scores)]
        top = F.array_max(F.array(*sums))
        chosen = F.when(F.size(hits) > 0, F.struct(top["s"].alias("score"), (top["w"] / F.size(hits)).alias("weight"), F.lit(None).cast("string").alias("id"))).otherwise(default)
    else:
        raise ModelError(f"unknown criterion {criterion!r}")
    (chosen,) = scope.stage(chosen)
    return {"": _null_state(chosen["score"], MISSING), "weight": _null_state(chosen["weight"], MISSING), "confidence": _null_state(chosen["weight"], MISSING), "entityId": _null_state(chosen["id"], MISSING)}


# Ensembles.


def _mining(model: Node, scope: Scope) -> Features:
    segmentation = model.first("Segmentation")
    method = segmentation.need("multipleModelMethod")
    scored = []
    for k, s in enumerate(segmentation.all("Segment")):
        hit = F.coalesce(predicate(s.first(*PREDICATES), scope), F.lit(False))
        inner = s.first(*MODELS)
        features = score_model(inner, scope)
        (hit,) = scope.stage(hit)
        features[""] = scope.staged(features[""])
        scored.append((s.get("id", str(k + 1)), s.number("weight", 1.0), hit, features))
    if method == "modelChain":
        raise ModelError("modelChain is not supported")
    usable = [h & (f[""].state == VALID) for _, _, h, f in scored]
    if method == "selectFirst":
        first = F.lit(None).cast("int")
        for k in reversed(range(len(scored))):
            first = F.when(scored[k][2], F.lit(k)).otherwise(first)
        (first,) = scope.stage(first)
        names = list(dict.fromkeys(n for *_, f in scored for n in f))
        out = {}
        for n in names:
            kind = "double" if n.startswith(("probability", "confidence", "weight", "affinity", "clusterAffinity", "all.", "pValue")) else None
            value, state = None, None
            for k, (*_, f) in enumerate(scored):
                if n in f:
                    v = f[n].value.cast(kind) if kind else f[n].value
                    value = F.when(first == k, v) if value is None else value.when(first == k, v)
                    state = F.when(first == k, f[n].state) if state is None else state.when(first == k, f[n].state)
            out[n] = MCol(value, state.otherwise(MISSING))
        out["segment"] = _null_state(F.element_at(F.array(*[F.lit(i) for i, *_ in scored]), F.coalesce(first, F.lit(0)) + 1), MISSING)
        out["segment"] = MCol(F.when(first.isNotNull(), out["segment"].value), F.when(first.isNull(), MISSING).otherwise(VALID))
        return out
    values = [f[""].value for *_, f in scored]
    if method == "selectAll":
        entries = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(i).alias("segment"), v.cast("string").alias("score"))) for (i, _, h, _), v in zip(scored, values, strict=True)]))
        return {"": MCol(entries), "cardinality": MCol(F.size(entries))}
    cardinality = reduce(lambda a, b: a + b, [u.cast("int") for u in usable])
    if method in ("majorityVote", "weightedMajorityVote"):
        votes = F.array_compact(F.array(*[F.when(u, F.struct(v.cast("string").alias("s"), F.lit(w if method.startswith("weighted") else 1.0).alias("w"))) for (_, w, _, _), u, v in zip(scored, usable, values, strict=True)]))
        labels = F.array_distinct(F.transform(votes, lambda x: x["s"]))
        votes, = scope.stage(votes)
        labels = F.array_distinct(F.transform(votes, lambda x: x["s"]))
        tally = F.transform(labels, lambda s: F.struct(F.aggregate(F.filter(votes, lambda x: x["s"] == s), F.lit(0.0), lambda a, x: a + x["w"]).alias("w"), (-F.array_position(labels, s)).alias("k"), s.alias("s")))
        return {"": _null_state(F.array_max(tally)["s"], MISSING), "cardinality": MCol(cardinality)}
    numbers = scope.stage(*(F.when(u, v.cast("double")) for u, v in zip(usable, values, strict=True)))
    weights = [w for _, w, _, _ in scored]
    add = lambda cols: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    some = cardinality > 0
    if method == "sum":
        value = add(numbers)
    elif method == "average":
        value = F.try_divide(add(numbers), cardinality.cast("double"))
    elif method == "weightedAverage":
        value = F.try_divide(add([c * w for c, w in zip(numbers, weights, strict=True)]), add([F.when(u, F.lit(float(w))) for u, w in zip(usable, weights, strict=True)]))
    elif method == "max":
        value = F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    elif method == "median":
        kept = F.array_sort(F.array_compact(F.array(*numbers)))
        n = F.size(kept)
        value = (F.try_element_at(kept, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.try_element_at(kept, (F.floor(n / 2) + 1).cast("int"))) / 2
    else:
        raise ModelError(f"unknown multipleModelMethod {method!r}")
    return {"": MCol(F.when(some, value), F.when(some, VALID).otherwise(MISSING)), "cardinality": MCol(cardinality)}


_SCORERS = {"BaselineModel": _baseline, "TreeModel": _tree, "RegressionModel": _regression, "NaiveBayesModel": _naive_bayes, "ClusteringModel": _clustering, "RuleSetModel": _rules, "MiningModel": _mining}


def score_model(model: Node, outer: Scope) -> Features:
    """Features of a model in a scope: mining fields are treated and local transformations added first."""
    if model.tag not in _SCORERS:
        raise ModelError(f"{model.tag} has no scorer")
    if model.get("isScorable", "true") in ("false", "0"):
        return {"": MCol(F.lit(None).cast("double"), F.lit(INVALID))}
    scope = outer.inner()
    schema = model.first("MiningSchema")
    for f in schema.all("MiningField") if schema else ():
        if f.get("usageType", "active") in ("active", "supplementary", "group", "order") and f.need("name") in scope.names:
            if treats(f):
                scope.names[f.need("name")] = scope.staged(mining_field(scope.find(f.need("name")), f))
    local = model.first("LocalTransformations")
    if local is not None:
        derived_fields(local, scope)
    features = _SCORERS[model.tag](model, scope)
    output = model.first("Output")
    if output is not None:
        features |= _output(output, features, scope)
    return features


def _output(output: Node, features: Features, scope: Scope) -> Features:
    out: Features = {}
    for f in output.all("OutputField"):
        feature = f.get("feature")
        inner = scope.inner({**{k: v for k, v in features.items() if k and not k.startswith("__")}, **out})
        if feature in ("transformedValue", "decision") or (feature is None and f.first(*EXPRESSIONS)):
            col = expression(child_expression(f), inner)
        elif feature is None:
            col = scope.find(f.get("field") or f.need("name"))
        elif feature in ("predictedValue", "predictedDisplayValue") and feature not in features:
            col = features[""]
        else:
            key = f"{feature}:{f.need('value')}" if f.get("value") and f"{feature}:{f.get('value')}" in features else feature
            if key not in features:
                raise ModelError(f"the model has no feature {key!r}")
            col = features[key]
            kids = f.first(*EXPRESSIONS)
            if kids is not None:
                col = expression(kids, inner)
        out[f"output:{f.need('name')}"] = cast(col, read_type(f)) if f.get("dataType") else col
        out[f.need("name")] = out[f"output:{f.need('name')}"]
    return out


def find_model(doc: Node) -> Node:
    if doc.tag in MODELS:
        return doc
    for c in doc.children:
        if c.tag in MODELS:
            return c
        if c.tag in UNSCORED:
            raise ModelError(f"{c.tag} has no scorer")
    raise ModelError("the document holds no model")


def input_scope(df: DataFrame, doc: Node, order_by: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), legacy: bool = False, last_match: bool = False) -> Scope:
    """Columns of the frame, cast as the DataDictionary says; all declared fields must be there."""
    dictionary = doc.first("DataDictionary")
    declared = {f.need("name"): f for f in dictionary.all("DataField")} if dictionary else {}
    absent = [n for n in declared if n not in df.columns]
    if absent:
        raise ModelError(f"the input lacks {', '.join(absent)}")
    kinds = dict(df.dtypes)
    names = {c: source(F.col(f"`{c}`"), kinds[c] in ("double", "float")) for c in df.columns}
    scope = Scope(names, {}, legacy, tuple(F.col(o) for o in order_by), tuple(F.col(p) for p in partition_by), last_match)
    for n, f in declared.items():
        kind = read_type(f)
        if kinds[n] != kind.spark or kind.valid or kind.missing or kind.invalid or kind.intervals:
            names[n] = scope.staged(cast(names[n], kind))
    transforms = doc.first("TransformationDictionary")
    if transforms is not None:
        define_functions(transforms, scope)
        derived_fields(transforms, scope)
    return scope


def score(df: DataFrame, doc: Node, keep: tuple[str, ...] = (), features: tuple[str, ...] = (), order_by: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), legacy: bool = False, masks: bool = False, last_match: bool = False) -> DataFrame:
    """Scores a frame: the kept columns, ``score``, the named features and the model's output fields.

    Column names of features have ":" and "." turned to "_". With ``masks``, score_mask tells missing (1)
    from invalid (2).
    """
    scope = input_scope(df, doc, order_by, partition_by, legacy, last_match)
    made = score_model(find_model(doc), scope)
    df = scope.applied(df)
    if "__cusum" in made:
        return _score_cusum(df, made, keep)
    tidy = lambda n: n.replace(":", "_").replace(".", "_")
    cols = [F.col(f"`{k}`") for k in keep] + [made[""].edge().alias("score")]
    if masks:
        cols.append(made[""].state.cast("int").alias("score_mask"))
    cols += [made[f].edge().alias(tidy(f)) for f in features]
    cols += [made[n].edge().alias(n.removeprefix("output:")) for n in made if n.startswith("output:")]
    return df.select(*cols)


def _score_cusum(df: DataFrame, made: dict, keep: tuple[str, ...]) -> DataFrame:
    step, reset, by, order = made["__cusum"]
    named = {f"__{k}{i}": F.col(c) if isinstance(c, str) else c for k, cols in (("b", by), ("o", order)) for i, c in enumerate(cols)}
    rows = df.withColumns({**named, "__step": step})
    scored = windows.cusum(rows, F.col("__step"), [n for n in named if n.startswith("__b")], [n for n in named if n.startswith("__o")], "__score", reset)
    return scored.select(*keep, F.col("__score").alias("score"))


def transform(df: DataFrame, doc: Node, names: tuple[str, ...], keep: tuple[str, ...] = (), order_by: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), legacy: bool = False, masks: bool = False, last_match: bool = False) -> DataFrame:
    """Derived fields of a document's TransformationDictionary; with ``masks`` also <name>__mask."""
    scope = input_scope(df, doc, order_by, partition_by, legacy, last_match)
    df = scope.applied(df)
    cols = [F.col(f"`{k}`") for k in keep]
    for n in names:
        cols.append(scope.find(n).edge().alias(n))
        if masks:
            cols.append(scope.find(n).state.cast("int").alias(f"{n}__mask"))
    return df.select(*cols)


def verify(spark, doc: Node, key: str = "case_no") -> DataFrame:
    """Runs a model's ModelVerification rows: case_no, field, expected, found, agrees."""
    model = find_model(doc)
    block = model.first("ModelVerification")
    fields = block.first("VerificationFields").all("VerificationField")
    rows = [{c.tag: c.text for c in r.children} for r in block.first("InlineTable").all("row")]
    wanted = {f.need("field"): (f.number("precision", 1e-6), f.number("zeroThreshold", 1e-16)) for f in fields}
    dictionary = doc.first("DataDictionary")
    inputs = [f.need("name") for f in dictionary.all("DataField")]
    frame = spark.createDataFrame([(k, *[r.get(n) for n in inputs]) for k, r in enumerate(rows)], f"{key} int, " + ", ".join(f"`{n}` string" for n in inputs))
    scored = score(frame, doc, keep=(key,))
    expected = [(k, n, r[n]) for k, r in enumerate(rows) for n in wanted if n in r and n not in inputs]
    facts = spark.createDataFrame(expected, f"{key} int, field string, expected string")
    found = scored.select(key, F.explode(F.create_map(*[x for n in wanted if n in scored.columns for x in (F.lit(n), F.col(n).cast("string"))])).alias("field", "found"))
    limits = spark.createDataFrame([(n, *v) for n, v in wanted.items()], "field string, precision double, zero double")
    joined = facts.join(found, [key, "field"], "left").join(F.broadcast(limits), "field")
    e, g = F.col("expected").try_cast("double"), F.col("found").try_cast("double")
    close = F.when((F.abs(e) <= F.col("zero")) & (F.abs(g) <= F.col("zero")), True).otherwise(F.abs(e - g) <= F.col("precision") * F.abs(e))
    return joined.select(key, "field", "expected", "found", F.coalesce(close, F.col("expected") == F.col("found"), F.lit(False)).alias("agrees"))


__all__ = ["as_missing", "find_model", "input_scope", "score", "score_model", "transform", "verify"]
