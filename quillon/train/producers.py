"""Baseline producers beyond the Gaussian one, covariance tables and k-means starts.

Aggregates run on the cluster; only distributions, tables of a checked size and small matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.ir import Node
from quillon.train import trainers

KINDS = ("gaussian", "poisson", "uniform")


def _distribution(kind: str, row: dict, prefix: str, zero_variance: str, default: float) -> Node | None:
    if not row[f"{prefix}n"]:
        return None
    if kind == "poisson":
        return Node("PoissonDistribution", {"mean": repr(row[f"{prefix}mean"])})
    if kind == "uniform":
        return Node("UniformDistribution", {"lower": repr(row[f"{prefix}low"]), "upper": repr(row[f"{prefix}high"])})
    variance = row[f"{prefix}variance"] or 0.0
    if variance <= 0:
        if zero_variance == "exception":
            raise ValueError("a segment has no variance")
        variance = default if zero_variance == "default" else 0.0
    return Node("GaussianDistribution", {"mean": repr(row[f"{prefix}mean"]), "variance": repr(variance)})


def baseline(df: DataFrame, x: str, kind: str = "gaussian", segment: str | None = None, alternate: tuple[str, object] | None = None, statistic: str = "zValue", zero_variance: str = "quiet", default: float = 1.0, most: int = 100_000) -> Node:
    """A Baseline document whose distribution is gaussian, poisson or uniform, one segment for each value of ``segment``.

    With ``alternate`` = (field, value), rows holding that value train the Alternate distribution and the others the
    Baseline. Null x is skipped, as are null segments. ``zero_variance`` is quiet (0), default or exception.
    Segments are counted: more than ``most`` are too many for one document and raise.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    other = F.lit(False) if alternate is None else F.col(alternate[0]).eqNullSafe(F.lit(alternate[1]))
    aggs = []
    for prefix, mine in (("b_", ~other), ("a_", other)):
        v = F.when(mine, F.col(x).cast("double"))
        aggs += [F.count(v).alias(f"{prefix}n"), F.avg(v).alias(f"{prefix}mean"), F.when(F.count(v) >= 2, F.var_samp(v)).alias(f"{prefix}variance"), F.min(v).alias(f"{prefix}low"), F.max(v).alias(f"{prefix}high")]
    rows = [r.asDict() for r in df.groupBy(*([segment] if segment else [])).agg(*aggs).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} segments")

    def model(row: dict) -> Node:
        base, alt = (_distribution(kind, row, p, zero_variance, default) for p in ("b_", "a_"))
        parts = [Node(tag, {}, [d]) for tag, d in (("Baseline", base), ("Alternate", alt)) if d is not None]
        return Node("BaselineModel", {"functionName": "regression"}, [Node("MiningSchema", {}, [Node("MiningField", {"name": x})]), Node("TestDistributions", {"field": x, "testStatistic": statistic}, parts)])

    declared = [Node("DataField", {"name": x, "optype": "continuous", "dataType": "double"})]
    if segment is None:
        body = model(rows[0])
    else:
        declared.append(Node("DataField", {"name": segment, "optype": "categorical", "dataType": "string"}))
        kept = sorted((r for r in rows if r[segment] is not None and r["b_n"]), key=lambda r: str(r[segment]))
        segments = [Node("Segment", {"id": str(r[segment])}, [Node("SimplePredicate", {"field": segment, "operator": "equal", "value": str(r[segment])}), model(r)]) for r in kept]
        body = Node("MiningModel", {"functionName": "regression"}, [Node("MiningSchema", {}, [Node("MiningField", {"name": n}) for n in (x, segment)]), Node("Segmentation", {"multipleModelMethod": "selectFirst"}, segments)])
    return Node("PMML", {"version": "4.1"}, [Node("DataDictionary", {}, declared), body])


def distributions(doc: Node) -> list[tuple[str | None, str, str, dict[str, float]]]:
    """(segment, Baseline or Alternate, tag, numbers) of every distribution in a document."""
    out = []

    def walk(node: Node, segment: str | None) -> None:
        for child in node.children:
            here = child.get("id") if child.tag == "Segment" else segment
            if child.tag in ("Baseline", "Alternate"):
                out.extend((segment, child.tag, d.tag, {k: float(v) for k, v in d.attrs.items()}) for d in child.children)
            walk(child, here)

    walk(doc, None)
    return out


def count_document(df: DataFrame, fields: Sequence[str], weight: str | None = None, most: int = 100_000) -> Node:
    """A count table of one or more fields as nested FieldValue elements, whose last level holds the counts.

    Cells are counted: more than ``most`` raise. Rows with a null in any field are skipped.
    """
    rows = trainers.count_table(df, fields, weight=weight).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cells")
    root = Node("CountTable", {"sample": repr(float(sum(r["count"] for r in rows)))})
    levels: dict[tuple, Node] = {(): root}
    for r in sorted(rows, key=lambda r: [str(r[f]) for f in fields]):
        path: tuple = ()
        for f in fields[:-1]:
            up, path = levels[path], (*path, str(r[f]))
            if path not in levels:
                levels[path] = Node("FieldValue", {"field": f, "value": str(r[f])})
                up.children.append(levels[path])
        levels[path].children.append(Node("FieldValueCount", {"field": fields[-1], "value": str(r[fields[-1]]), "count": repr(float(r["count"]))}))
    return root


def cells(table: Node) -> list[tuple[tuple[str, ...], float]]:
    """((values), count) of a count table."""
    out = []

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for child in node.children:
            here = (*path, child.need("value"))
            if child.tag == "FieldValueCount":
                out.append((here, float(child.need("count"))))
            else:
                walk(child, here)

    walk(table, ())
    return out


def covariance(df: DataFrame, fields: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, a, b, n, mean_a, mean_b, covariance): population covariances of all pairs of fields, a row for each.

    Only rows with every field count. With a weight n is its sum. One aggregate, about a first guess of the means,
    so that large means cost no digits.
    """
    whole = df.where(reduce(lambda p, q: p & q, [F.col(f).isNotNull() for f in fields]))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if weight is not None:
        whole = whole.where(F.col(weight) > 0)
    x = {f: F.col(f).cast("double") for f in fields}
    if weight is None:
        pairs = [(F.avg(x[a]), F.avg(x[b]), F.covar_pop(x[a], x[b])) for a in fields for b in fields]
    else:
        guess = whole.agg(*[F.coalesce(F.avg(x[f]), F.lit(0.0)).alias(f) for f in fields]).first()
        c = {f: x[f] - float(guess[f]) for f in fields}
        mean = {f: F.try_divide(F.sum(c[f] * w), F.sum(w)) for f in fields}
        pairs = [(mean[a] + float(guess[a]), mean[b] + float(guess[b]), F.try_divide(F.sum(c[a] * c[b] * w), F.sum(w)) - mean[a] * mean[b]) for a in fields for b in fields]
    named = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), p[0].alias("mean_a"), p[1].alias("mean_b"), p[2].alias("covariance")) for (a, b), p in zip([(a, b) for a in fields for b in fields], pairs, strict=True)]
    out = whole.groupBy(*by).agg(F.sum(w).alias("n"), F.array(*named).alias("p")).where("n > 0")
    return out.select(*by, "n", F.explode("p").alias("p")).select(*by, "n", "p.*")


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, n, slope, intercept): weighted least squares of y on x within each key; no spread in x gives null."""
    c = covariance(df, (x, y), by, weight)
    wide = c.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("covariance"))).alias(k) for a, b, k in ((x, x, "__xx"), (x, y, "__xy"))], F.max(F.when(F.col("a") == x, F.col("mean_a"))).alias("__mx"), F.max(F.when(F.col("a") == y, F.col("mean_a"))).alias("__my"))
    slope = F.try_divide(F.col("__xy"), F.when(F.col("__xx") > 0, F.col("__xx")))
    return wide.select(*by, "n", slope.alias("slope"), (F.col("__my") - slope * F.col("__mx")).alias("intercept"))


def starts(df: DataFrame, fields: Sequence[str], k: int, seed: int, method: str = "data", weight: str | None = None) -> list[list[float]]:
    """k starting centres: rows of the data, rows drawn by weight, normal draws with the data's covariance, or points of the unit cube.

    Draws depend on the seed alone. ``data`` and ``weighted`` give fewer when there are fewer distinct rows.
    """
    if method == "data":
        return trainers.seeds(df, fields, k, seed)
    rng = np.random.default_rng(seed)
    if method == "unitRect":
        return rng.random((k, len(fields))).tolist()
    if method == "weighted":
        rows = df.groupBy(*[F.col(f).cast("double").alias(f) for f in fields]).agg(F.sum(weight).alias("__w")).na.drop().where("__w > 0")
        # The least of exponential clocks whose rates are the weights.
        u = (F.pmod(F.xxhash64(F.lit(seed), *fields), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        return [[r[f] for f in fields] for r in rows.orderBy(-F.ln(u) / F.col("__w"), *fields).limit(k).collect()]
    if method == "covariance":
        rows = covariance(df, fields).collect()
        if not rows:
            return []
        at = {f: i for i, f in enumerate(fields)}
        sigma, mean = np.zeros((len(fields), len(fields))), np.zeros(len(fields))
        for r in rows:
            sigma[at[r["a"]], at[r["b"]]] = r["covariance"]
            mean[at[r["a"]]] = r["mean_a"]
        values, axes = np.linalg.eigh(sigma)
        return (mean + (rng.standard_normal((k, len(fields))) * np.sqrt(np.maximum(values, 0))) @ axes.T).tolist()
    raise ValueError(f"unknown method {method!r}")


def converged_trials(df: DataFrame, fields: Sequence[str], k: int, trials: int = 10, number: int = 3, close_enough: float = 1e-3, seed: int = 1, method: str = "data", weight: str | None = None, **options) -> trainers.Clusters:
    """Trials with different starts until ``number`` of them agree with the best mean distance within ``close_enough``; the best one."""
    done: list[trainers.Clusters] = []
    for t in range(trials):
        done.append(trainers.k_means(df, fields, starts(df, fields, k, seed + t, method, weight), weight=weight, **options))
        best = min(done, key=lambda c: c.mean_distance)
        if sum(c.mean_distance - best.mean_distance <= close_enough for c in done) >= number:
            break
    return best


def small_trials(df: DataFrame, fields: Sequence[str], k: int, rows: int = 100, tries: int = 5, seed: int = 1) -> list[list[float]]:
    """The best of some starts by their fit on ``rows`` rows drawn by hash: only a start, from which all rows are then used."""
    drawn = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).na.drop().orderBy(F.xxhash64(F.lit(seed), *fields), *fields).limit(rows)
    points = np.array([list(r) for r in drawn.collect()])
    if not len(points):
        return []
    k, rng, best = min(k, len(points)), np.random.default_rng(seed), (np.inf, None)
    for _ in range(tries):
        centers = points[rng.choice(len(points), k, replace=False)]
        for _ in range(20):
            near = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)
            mine = near.argmin(axis=1)
            centers = np.array([points[mine == i].mean(axis=0) if (mine == i).any() else centers[i] for i in range(k)])
        fit = float(np.sqrt(near.min(axis=1)).mean())
        if fit < best[0]:
            best = (fit, centers.tolist())
    return best[1]


