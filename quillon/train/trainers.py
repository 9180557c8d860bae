"""Trainers: distributed aggregates, small models on the driver, and model documents as results.

Only sums, counts and centres, whose size depends on the model and not on the rows, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.plans.ir import Node


def moments(df: DataFrame, x: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """count, mean, variance (unbiased), low and high of each segment; null x is skipped. With a weight, weighted mean and population variance."""
    if weight is None:
        n = F.count(x)
        return df.groupBy(*by).agg(n.alias("count"), F.avg(x).alias("mean"), F.when(n >= 2, F.var_samp(x)).alias("variance"), F.min(x).alias("low"), F.max(x).alias("high"))
    ok = F.when(F.col(x).isNotNull(), F.col(weight))
    s, s1, s2 = F.sum(ok), F.sum(ok * F.col(x)), F.sum(ok * F.col(x) * F.col(x))
    mean = F.try_divide(s1, s)
    return df.groupBy(*by).agg(s.alias("count"), mean.alias("mean"), (F.try_divide(s2, s) - mean * mean).alias("variance"), F.min(x).alias("low"), F.max(x).alias("high"))


def count_table(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n-way counts of field values within each segment; rows with a null field are skipped."""
    kept = df.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields]))
    return kept.groupBy(*by, *fields).agg((F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)).alias("count"))


def baseline_document(df: DataFrame, x: str, segment: str | None = None, statistic: str = "zValue") -> Node:
    """A Baseline model trained on x, one segment for each value of ``segment``. As many rows as there are segments reach the driver."""

    def model(mean: float, variance: float) -> Node:
        return Node("BaselineModel", {"functionName": "regression"}, [Node("MiningSchema", {}, [Node("MiningField", {"name": x})]), Node("TestDistributions", {"field": x, "testStatistic": statistic}, [Node("Baseline", {}, [Node("GaussianDistribution", {"mean": repr(mean), "variance": repr(variance)})])])])

    rows = moments(df, x, (segment,) if segment else ()).collect()
    declared = [Node("DataField", {"name": x, "optype": "continuous", "dataType": "double"})]
    if segment is None:
        body = model(rows[0]["mean"], rows[0]["variance"])
    else:
        declared.append(Node("DataField", {"name": segment, "optype": "categorical", "dataType": "string"}))
        segments = [Node("Segment", {"id": str(r[segment])}, [Node("SimplePredicate", {"field": segment, "operator": "equal", "value": str(r[segment])}), model(r["mean"], r["variance"] or 0.0)]) for r in sorted(rows, key=lambda r: str(r[segment])) if r[segment] is not None and r["count"]]
        body = Node("MiningModel", {"functionName": "regression"}, [Node("MiningSchema", {}, [Node("MiningField", {"name": n}) for n in (x, segment)]), Node("Segmentation", {"multipleModelMethod": "selectFirst"}, segments)])
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, declared), body])


#: Links whose inverse straightens the target before least squares.
_STRAIGHTEN = {"none": lambda y: y, "exp": F.ln, "logit": lambda y: F.ln(y / (1 - y)), "softmax": lambda y: F.ln(y / (1 - y))}


def least_squares(df: DataFrame, target: str, predictors: Sequence[str], by: Sequence[str] = (), link: str = "none") -> list[dict]:
    """Normal equations by one aggregate for each segment; p × p sums are solved on the driver. Rows with a null are skipped."""
    y = _STRAIGHTEN[link](F.col(target).cast("double"))
    terms = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    ok = reduce(lambda a, b: a & b, [t.isNotNull() for t in terms[1:]] + [y.isNotNull()])
    n = len(terms)
    aggs = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(terms[i] * y).alias(f"b{i}") for i in range(n)]
    out = []
    for r in df.where(ok).groupBy(*by).agg(*aggs).collect():
        if r["g0_0"] is None:
            continue
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        beta = np.linalg.lstsq(g / scale[:, None] / scale[None, :], np.array([r[f"b{i}"] for i in range(n)], float) / scale, rcond=None)[0] / scale
        out.append({**{b: r[b] for b in by}, "rows": int(r["g0_0"]), "intercept": float(beta[0]), **{p: float(v) for p, v in zip(predictors, beta[1:], strict=True)}})
    return out


def regression_document(fit: Mapping, predictors: Sequence[str], link: str = "none") -> Node:
    table = Node("RegressionTable", {"intercept": repr(fit["intercept"])}, [Node("NumericPredictor", {"name": p, "coefficient": repr(fit[p])}) for p in predictors])
    model = Node("RegressionModel", {"functionName": "regression", "normalizationMethod": link}, [Node("MiningSchema", {}, [Node("MiningField", {"name": p}) for p in predictors]), table])
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, [Node("DataField", {"name": p, "optype": "continuous", "dataType": "double"}) for p in predictors]), model])


def bayes_counts(df: DataFrame, target: str, inputs: Sequence[str]) -> DataFrame:
    """(field, value, target, count): pair counts of every input, and of the target itself under its own name."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in (*inputs, target)])
    stacked = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("target"), F.explode(cells).alias("c")).select("c.field", "c.value", "target").where("value is not null")
    return stacked.groupBy("field", "value", "target").count()


def bayes_document(df: DataFrame, target: str, inputs: Sequence[str], threshold: float = 0.001, most: int = 100_000) -> Node:
    """A naive Bayes document; the number of pair counts is checked against ``most`` before they are gathered."""
    rows = bayes_counts(df, target, inputs).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pair counts")

    def tally(pairs: Sequence[tuple[str, int]]) -> Node:
        return Node("TargetValueCounts", {}, [Node("TargetValueCount", {"value": v, "count": str(c)}) for v, c in sorted(pairs)])

    made = []
    for f in inputs:
        values = sorted({r["value"] for r in rows if r["field"] == f})
        made.append(Node("BayesInput", {"fieldName": f}, [Node("PairCounts", {"value": v}, [tally([(r["target"], r["count"]) for r in rows if r["field"] == f and r["value"] == v])]) for v in values]))
    out = Node("BayesOutput", {"fieldName": target}, [tally([(r["target"], r["count"]) for r in rows if r["field"] == target])])
    model = Node("NaiveBayesModel", {"functionName": "classification", "threshold": repr(threshold)}, [Node("MiningSchema", {}, [Node("MiningField", {"name": f}) for f in inputs]), Node("BayesInputs", {}, made), out])
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, [Node("DataField", {"name": f, "optype": "categorical", "dataType": "string"}) for f in inputs]), model])


@dataclass
class Clusters:
    centers: list[list[float]]
    counts: list[float] = field(default_factory=list)
    mean_distance: float = math.inf
    iterations: int = 0
    moved: float = math.inf


def nearest(centers: Sequence[Sequence[float]], fields: Sequence[str]) -> tuple[Column, Column]:
    """Place of the nearest centre and the squared distance."""
    parts = [F.struct(reduce(lambda a, b: a + b, [F.pow(F.col(f).cast("double") - c, F.lit(2.0)) for f, c in zip(fields, center, strict=True)]).alias("d"), F.lit(k).alias("k")) for k, center in enumerate(centers)]
    best = F.array_min(F.array(*parts))
    return best["k"], best["d"]


def k_means(df: DataFrame, fields: Sequence[str], start: Sequence[Sequence[float]], most_iterations: int = 20, close_enough: float = 1e-6, weight: str | None = None, zero_empty: bool = False, quick: float | None = None) -> Clusters:
    """Lloyd's algorithm: each round is one narrow assignment and one small aggregate.

    Rows with a null field are skipped. An empty cluster keeps its centre, or moves to 0 with ``zero_empty``.
    ``quick``, a share of the rows, first finds centres on a sample, from which the rounds over all rows start.
    """
    if quick:
        drawn = df.where(F.pmod(F.xxhash64(*fields), F.lit(1_000_000)) < int(quick * 1_000_000))
        start = k_means(drawn, fields, start, most_iterations, close_enough, weight).centers
    rows = df.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields]))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    now = Clusters([list(map(float, c)) for c in start])
    for _ in range(most_iterations):
        k, d = nearest(now.centers, fields)
        found = rows.select(*fields, w.alias("__w"), k.alias("__k"), d.alias("__d")).groupBy("__k").agg(F.sum("__w").alias("n"), F.sum(F.sqrt("__d") * F.col("__w")).alias("d"), *[F.try_divide(F.sum(F.col(f) * F.col("__w")), F.sum("__w")).alias(f"c{i}") for i, f in enumerate(fields)]).collect()
        by = {r["__k"]: r for r in found}
        total = sum(r["n"] for r in found) or 1.0
        fresh = [[by[i][f"c{j}"] for j in range(len(fields))] if i in by else [0.0] * len(fields) if zero_empty else c for i, c in enumerate(now.centers)]
        moved = max(math.dist(a, b) for a, b in zip(fresh, now.centers, strict=True))
        now = Clusters(fresh, [by[i]["n"] if i in by else 0.0 for i in range(len(fresh))], sum(r["d"] for r in found) / total, now.iterations + 1, moved)
        if moved <= close_enough:
            break
    return now


def seeds(df: DataFrame, fields: Sequence[str], k: int, seed: int) -> list[list[float]]:
    """k distinct rows drawn by a seeded hash; k shrinks to the number of distinct rows."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).na.drop().distinct()
    return [list(r) for r in rows.orderBy(F.xxhash64(F.lit(seed), *fields), *fields).limit(k).collect()]


def k_means_trials(df: DataFrame, fields: Sequence[str], k: int, trials: int = 3, seed: int = 1, **options) -> Clusters:
    """The trial of lowest mean distance."""
    return min((k_means(df, fields, seeds(df, fields, k, seed + t), **options) for t in range(trials)), key=lambda c: c.mean_distance)


def clustering_document(found: Clusters, fields: Sequence[str]) -> Node:
    n = str(len(fields))
    clusters = [Node("Cluster", {"id": str(i + 1), "size": str(int(c))}, [Node("Array", {"n": n, "type": "real"}, [], " ".join(map(repr, center)))]) for i, (center, c) in enumerate(zip(found.centers, found.counts or [0] * len(found.centers), strict=True))]
    model = Node("ClusteringModel", {"functionName": "clustering", "modelClass": "centerBased", "numberOfClusters": str(len(clusters))}, [Node("MiningSchema", {}, [Node("MiningField", {"name": f}) for f in fields]), Node("ComparisonMeasure", {"kind": "distance"}, [Node("euclidean")]), *[Node("ClusteringField", {"field": f}) for f in fields], *clusters])
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, [Node("DataField", {"name": f, "optype": "continuous", "dataType": "double"}) for f in fields]), model])


# Trees.


def _binned(base: DataFrame, numeric: Sequence[str], bins: int | None) -> DataFrame:
    """Numeric values rounded up to quantiles; those above the last take a value of their own."""
    if not bins or not numeric:
        return base
    edges = base.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in numeric]).first()
    for f in numeric:
        cuts = sorted(set(edges[f] or []))
        if cuts:
            base = base.withColumn(f, F.coalesce(*[F.when(F.col(f) <= c, F.lit(float(c))) for c in cuts], F.when(F.col(f).isNotNull(), F.lit(math.nextafter(cuts[-1], math.inf) + 1.0))))
    return base


def _entries(numeric: Sequence[str], categorical: Sequence[str]) -> list[Column]:
    out = [F.struct(F.lit(f).alias("field"), F.lit("numeric").alias("kind"), F.col(f).cast("double").alias("v"), F.lit(None).cast("string").alias("s")) for f in numeric]
    return out + [F.struct(F.lit(f).alias("field"), F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("v"), F.col(f).cast("string").alias("s")) for f in categorical]


def regression_gains(df: DataFrame, node: str, target: str, numeric: Sequence[str], categorical: Sequence[str], bins: int | None = None) -> DataFrame:
    """As split_gains for a numeric target: n·var of the parent less n·var of both parts."""
    base = _binned(df.where(F.col(target).isNotNull()), numeric, bins)
    cells = base.select(F.col(node).alias("node"), F.col(target).cast("double").alias("y"), F.explode(F.array(*_entries(numeric, categorical))).alias("e")).select("node", "y", "e.*").where("v is not null or s is not null")
    sums = cells.groupBy("node", "field", "kind", "v", "s").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("a"), F.sum(F.col("y") * F.col("y")).alias("b"))
    group = W.partitionBy("node", "field")
    upto = group.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    cat = F.col("kind") == "categorical"
    sums = sums.withColumns({f"l{c}": F.when(cat, F.col(c)).otherwise(F.sum(c).over(upto)) for c in "nab"} | {f"t{c}": F.sum(c).over(group) for c in "nab"} | {"up": F.lead("v").over(group.orderBy("v"))})
    sums = sums.where("ln < tn")
    spread = lambda n, a, b: b - a * a / n
    left, whole = [F.col(f"l{c}") for c in "nab"], [F.col(f"t{c}") for c in "nab"]
    gain = spread(*whole) - spread(*left) - spread(*[t - v for t, v in zip(whole, left, strict=True)])
    cut = F.when(cat, F.col("s")).otherwise(((F.col("v") + F.coalesce("up", "v")) / 2).cast("string"))
    return sums.select("node", "field", "kind", cut.alias("cut"), gain.alias("gain"), F.col("ln").cast("long").alias("rows_left"), F.col("tn").cast("long").alias("rows"))


def split_gains(df: DataFrame, node: str, target: str, numeric: Sequence[str], categorical: Sequence[str], bins: int | None = None, impurity: str = "entropy") -> DataFrame:
    """(node, field, kind, cut, gain, rows_left, rows): the gain of every binary split of every node.

    Numeric: value <= cut against above, cuts midway between neighbouring values; categorical: one value
    against the rest. Gain is the entropy (base 2) of the parent less the weighted entropy of the parts.
    Counts by (node, field, value, class) come before any window, so windows run over values, not rows.
    ``bins`` first rounds numeric values to that many quantiles. With ``impurity="gini"`` the Gini index
    takes the entropy's place.
    """
    base = _binned(df.where(F.col(target).isNotNull()), numeric, bins)
    entries = _entries(numeric, categorical)
    cells = base.select(F.col(node).alias("node"), F.col(target).cast("string").alias("y"), F.explode(F.array(*entries)).alias("e")).select("node", "y", "e.*").where("v is not null or s is not null")
    counts = cells.groupBy("node", "field", "kind", "v", "s", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    group = W.partitionBy("node", "field", "y")
    whole = F.sum("n").over(group)
    counts = counts.withColumns({"total": whole, "left": F.when(F.col("kind") == "categorical", F.col("n")).otherwise(F.sum("n").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))})
    # Classes absent at a value keep their counts from the last value before it: the classes' steps are merged by value.
    values = counts.select("node", "field", "kind", "v", "s").distinct()
    classes = counts.select("node", "field", "y", "total").distinct()
    full = values.join(classes, ["node", "field"])
    joined = full.alias("f").join(counts.select("node", "field", "v", "s", "y", "left").alias("c"), (F.col("f.node") == F.col("c.node")) & (F.col("f.field") == F.col("c.field")) & (F.col("f.y") == F.col("c.y")) & F.col("f.v").eqNullSafe(F.col("c.v")) & F.col("f.s").eqNullSafe(F.col("c.s")), "left").select("f.*", "c.left")
    filled = joined.withColumn("left", F.when(F.col("kind") == "categorical", F.coalesce("left", F.lit(0.0))).otherwise(F.coalesce(F.last("left", ignorenulls=True).over(W.partitionBy("node", "field", "y").orderBy("v").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))))
    if impurity not in ("entropy", "gini"):
        raise ValueError(f"unknown impurity {impurity!r}")
    x = lambda c: F.when(F.col(c) > 0, F.col(c) * (F.log2(c) if impurity == "entropy" else F.col(c))).otherwise(0.0)
    filled = filled.withColumn("right", F.col("total") - F.col("left"))
    sums = filled.groupBy("node", "field", "kind", "v", "s").agg(F.sum("left").alias("l"), F.sum("right").alias("r"), F.sum("total").alias("t"), F.sum(x("left")).alias("xl"), F.sum(x("right")).alias("xr"), F.sum(x("total")).alias("xt"))
    sums = sums.where("l > 0 and r > 0")
    after = F.lead("v").over(W.partitionBy("node", "field").orderBy("v"))
    if impurity == "entropy":
        before = F.log2("t") - F.col("xt") / F.col("t")
        parts = (F.col("l") * F.log2("l") - F.col("xl") + F.col("r") * F.log2("r") - F.col("xr")) / F.col("t")
    else:
        before = 1 - F.col("xt") / (F.col("t") * F.col("t"))
        parts = (F.col("l") - F.col("xl") / F.col("l") + F.col("r") - F.col("xr") / F.col("r")) / F.col("t")
    nexts = values.where("kind = 'numeric'").withColumn("up", after).select("node", "field", "v", "up")
    out = sums.join(nexts, ["node", "field", "v"], "left")
    cut = F.when(F.col("kind") == "numeric", ((F.col("v") + F.coalesce("up", "v")) / 2).cast("string")).otherwise(F.col("s"))
    return out.select("node", "field", "kind", cut.alias("cut"), (before - parts).alias("gain"), F.col("l").cast("long").alias("rows_left"), F.col("t").cast("long").alias("rows"))


def _label(counts: Sequence[tuple[str, int]]) -> str:
    return max(sorted(counts), key=lambda c: c[1])[0]


def grow_tree(df: DataFrame, target: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), depth: int = 5, least_rows: int = 2, least_gain: float = 0.0, bins: int | None = None, impurity: str = "entropy", regression: bool = False) -> Node:
    """A classification or regression tree grown level by level: each level is one aggregate over all rows and all open nodes.

    The best split of each node, a row a node, and its class counts reach the driver. Ties go to the first
    field and cut by name.
    """

    def name(k: str, hit: bool) -> str:
        return f"{k}{'l' if hit else 'r'}"

    rows = df.where(F.col(target).isNotNull()).withColumn("__node", F.lit("n"))
    splits: dict[str, tuple[str, str, str]] = {}
    tallies: dict[str, list[tuple[str, int]]] = {}
    open_nodes = {"n"}
    for level in range(depth + 1):
        here = rows.where(F.col("__node").isin(list(open_nodes)))
        if regression:
            found = here.groupBy("__node").agg(F.count(F.lit(1)).alias("count"), F.avg(target).alias("y"), F.min(target).alias("a"), F.max(target).alias("b")).collect()
            for r in found:
                tallies[r["__node"]] = [(repr(float(r["y"])), r["count"])]
            pure = {k for k in open_nodes if k not in tallies} | {r["__node"] for r in found if r["a"] == r["b"] or r["count"] < least_rows}
        else:
            for r in here.groupBy("__node", F.col(target).cast("string").alias("y")).count().collect():
                tallies.setdefault(r["__node"], []).append((r["y"], r["count"]))
            pure = {k for k in open_nodes if len(tallies.get(k, [])) < 2 or sum(c for _, c in tallies[k]) < least_rows}
        open_nodes -= pure
        if level == depth or not open_nodes:
            break
        left = rows.where(F.col("__node").isin(list(open_nodes)))
        gains = regression_gains(left, "__node", target, numeric, categorical, bins) if regression else split_gains(left, "__node", target, numeric, categorical, bins, impurity)
        best = gains.where(F.col("gain") > least_gain + 1e-12).groupBy("node").agg(F.min(F.struct((-F.round("gain", 12)).alias("g"), "field", "cut", "kind")).alias("b")).collect()
        fresh, steps = set(), None
        for r in best:
            b = r["b"]
            splits[r["node"]] = (b["field"], b["kind"], b["cut"])
            hit = F.col(b["field"]) <= float(b["cut"]) if b["kind"] == "numeric" else F.col(b["field"]).cast("string") == b["cut"]
            moved = F.when(hit, name(r["node"], True)).when(~hit, name(r["node"], False))
            steps = F.when(F.col("__node") == r["node"], moved) if steps is None else steps.when(F.col("__node") == r["node"], moved)
            fresh |= {name(r["node"], True), name(r["node"], False)}
        if steps is None:
            break
        rows = rows.withColumn("__node", steps)
        open_nodes = fresh

    def build(k: str, predicate: Node) -> Node:
        counts = tallies.get(k, [])
        kids = []
        if k in splits:
            f, kind, cut = splits[k]
            yes, no = ("lessOrEqual", "greaterThan") if kind == "numeric" else ("equal", "notEqual")
            kids = [build(name(k, hit), Node("SimplePredicate", {"field": f, "operator": op, "value": cut})) for hit, op in ((True, yes), (False, no))]
        spread = [] if regression else [Node("ScoreDistribution", {"value": v, "recordCount": str(c)}) for v, c in sorted(counts)]
        return Node("Node", {"id": k, "score": _label(counts) if counts else "", "recordCount": str(sum(c for _, c in counts))}, [predicate, *spread, *kids])

    fields = [*numeric, *categorical]
    model = Node("TreeModel", {"functionName": "regression" if regression else "classification", "splitCharacteristic": "binarySplit", "noTrueChildStrategy": "returnLastPrediction"}, [Node("MiningSchema", {}, [Node("MiningField", {"name": f}) for f in fields]), build("n", Node("True"))])
    declared = [Node("DataField", {"name": f, "optype": "continuous" if f in numeric else "categorical", "dataType": "double" if f in numeric else "string"}) for f in fields]
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, declared), model])


def rule_set(tree: Node) -> Node:
    """The leaves of a tree document as a first-hit rule set."""
    root = next(n for n in tree.walk() if n.tag == "TreeModel")
    rules: list[Node] = []

    def walk(n: Node, path: list[Node]) -> None:
        here = [*path, *[c for c in n.children if c.tag in ("SimplePredicate", "True")]]
        kids = n.all("Node")
        for k in kids:
            walk(k, here)
        if not kids:
            rules.append(Node("SimpleRule", {"id": n.need("id"), "score": n.need("score"), "weight": n.get("recordCount", "1")}, [Node("CompoundPredicate", {"booleanOperator": "and"}, [*here, Node("True")])]))

    walk(root.first("Node"), [])
    model = Node("RuleSetModel", {"functionName": "classification"}, [root.first("MiningSchema"), Node("RuleSet", {}, [Node("RuleSelectionMethod", {"criterion": "firstHit"}), *rules])])
    return Node("PMML", {"version": "4.1"}, [tree.first("DataDictionary"), model])
