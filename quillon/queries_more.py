"""Queries of producers, contingency and distance operators, further scorers, table verbs and hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import formula, hooks
from quillon.operators import segments, tables, windows
from quillon.plans import ir, models
from quillon.queries_functions import _CTE, frame
from quillon.queries_models import _EVENT_FIELDS, _LINE_KEY, document
from quillon.registry import query
from quillon.session import scratch, table
from quillon.sources import files
from quillon.train import producers, trainers

_KEY = ", ".join(_LINE_KEY)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


# --- producers ---------------------------------------------------------------------------------------------


@query("train_baseline_poisson", "SELECT l_returnflag AS segment, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def train_baseline_poisson(spark: SparkSession, d: str) -> DataFrame:
    doc = ir.load(ir.to_xml(producers.baseline(_lines(spark, d), "l_quantity", "poisson", "l_returnflag")))
    return spark.createDataFrame([(s, round(v["mean"], 6)) for s, _, _, v in producers.distributions(doc)], "segment string, mean double")


@query("train_baseline_uniform", "SELECT l_returnflag AS segment, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def train_baseline_uniform(spark: SparkSession, d: str) -> DataFrame:
    doc = producers.baseline(_lines(spark, d), "l_extendedprice", "uniform", "l_returnflag")
    return spark.createDataFrame([(s, v["lower"], v["upper"]) for s, _, _, v in producers.distributions(doc)], "segment string, low double, high double")


@query("train_baseline_alternate", "SELECT l_returnflag AS segment, CASE WHEN l_linestatus = 'F' THEN 'Alternate' ELSE 'Baseline' END AS part, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 5) AS variance FROM lineitem WHERE l_returnflag IN (SELECT l_returnflag FROM lineitem WHERE l_linestatus <> 'F') GROUP BY ALL")
def train_baseline_alternate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the alternate value train the other distribution; a segment without baseline rows has no model."""
    doc = producers.baseline(_lines(spark, d), "l_quantity", "gaussian", "l_returnflag", alternate=("l_linestatus", "F"))
    return spark.createDataFrame([(s, p, round(v["mean"], 6), round(v["variance"], 5)) for s, p, _, v in producers.distributions(doc)], "segment string, part string, mean double, variance double")


@query("train_count_document", "SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL")
def train_count_document(spark: SparkSession, d: str) -> DataFrame:
    doc = ir.load(ir.to_xml(producers.count_document(_lines(spark, d), ("l_returnflag", "l_linestatus"))))
    return spark.createDataFrame([(*v, n) for v, n in producers.cells(doc)], "a string, b string, n double")


_F3 = ("l_quantity", "l_extendedprice", "l_discount")


@query("agg_covariance", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, CAST(count(*) AS DOUBLE) AS n, round(avg({a}), 5) AS mean_a, round(covar_pop({a}, {b}), 3) AS covariance FROM lineitem GROUP BY 1" for a in _F3 for b in _F3))
def agg_covariance(spark: SparkSession, d: str) -> DataFrame:
    out = producers.covariance(_lines(spark, d), _F3, ("l_returnflag",))
    return out.select("l_returnflag", "a", "b", "n", F.round("mean_a", 5).alias("mean_a"), F.round("covariance", 3).alias("covariance"))


@query(
    "train_line_weighted",
    "WITH m AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_tax) / sum(l_quantity) AS my, sum(l_quantity * l_discount * l_tax) / sum(l_quantity) AS mxy, sum(l_quantity * l_discount * l_discount) / sum(l_quantity) AS mxx FROM lineitem GROUP BY 1) "
    "SELECT l_returnflag, CAST(w AS DOUBLE) AS n, round((mxy - mx * my) / (mxx - mx * mx), 6) AS slope, round(my - (mxy - mx * my) / (mxx - mx * mx) * mx, 6) AS intercept FROM m",
)
def train_line_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = producers.line_fit(_lines(spark, d), "l_discount", "l_tax", ("l_returnflag",), "l_quantity")
    return out.select("l_returnflag", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


_START = ((10.0, 0.02), (25.0, 0.05), (40.0, 0.08))
_D = ["pow(l_quantity - {}, 2) + pow(l_discount - {}, 2)".format(*c) for c in _START]


@query("train_kmeans_weighted", f"SELECT CASE WHEN {_D[0]} <= least({_D[1]}, {_D[2]}) THEN 0 WHEN {_D[1]} <= {_D[2]} THEN 1 ELSE 2 END AS cluster, CAST(sum(l_extendedprice) AS DOUBLE) AS n, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS a, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS b FROM lineitem GROUP BY 1")
def train_kmeans_weighted(spark: SparkSession, d: str) -> DataFrame:
    found = trainers.k_means(_lines(spark, d), ("l_quantity", "l_discount"), _START, 1, weight="l_extendedprice")
    return spark.createDataFrame([(k, n, round(c[0], 6), round(c[1], 6)) for k, (c, n) in enumerate(zip(found.centers, found.counts, strict=True))], "cluster int, n double, a double, b double")


@query("train_zero_variance", "WITH m AS (SELECT l_orderkey, avg(l_quantity) AS a, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN v > 0 THEN (l_quantity - a) / sqrt(v) WHEN v = 0 THEN -1 END, 6) AS score FROM lineitem JOIN m USING (l_orderkey)")
def train_zero_variance(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines have one quantity have no variance, those of one line no estimate: the default goes to the former."""
    rows = _lines(spark, d)
    m = trainers.moments(rows, "l_quantity", ("l_orderkey",)).select("l_orderkey", "mean", "variance")
    z = segments.zero_variance(F.col("l_quantity"), F.col("mean"), F.col("variance"), "default", -1.0)
    return rows.join(m, "l_orderkey").select(*_LINE_KEY, F.round(z, 6).alias("score"))


# --- contingency and distance ----------------------------------------------------------------------------------


@query(
    "cd_chi_square_independence_n",
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, year(o_orderdate) AS c, count(*) * 1.0 AS n FROM orders GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), ma AS (SELECT a, sum(n) AS m FROM c GROUP BY 1), mb AS (SELECT b, sum(n) AS m FROM c GROUP BY 1), mc AS (SELECT c, sum(n) AS m FROM c GROUP BY 1), "
    "g AS (SELECT ma.a, mb.b, mc.c, ma.m * mb.m * mc.m / (t * t) AS e FROM ma, mb, mc, t) SELECT round(sum(pow(coalesce(n, 0) - e, 2) / e), 6) AS chi_square, (count(DISTINCT g.a) - 1) * (count(DISTINCT g.b) - 1) * (count(DISTINCT g.c) - 1) AS ndf FROM g LEFT JOIN c USING (a, b, c)",
)
def cd_chi_square_independence_n(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return windows.chi_square_independence(rows, "o_orderstatus", "o_orderpriority", "year").withColumn("chi_square", F.round("chi_square", 6))


@query(
    "cd_distance_by_condition",
    "WITH o AS (SELECT user_id, event_type, sum(value) AS o FROM events GROUP BY ALL), e AS (SELECT user_id, event_type, count(*) * 1.0 AS e FROM events GROUP BY ALL) SELECT user_id, round(CAST(2 * sum(coalesce(o, 0) * coalesce(e, 0)) / (sum(coalesce(o, 0) * coalesce(o, 0)) + sum(coalesce(e, 0) * coalesce(e, 0))) AS DOUBLE), 6) AS score FROM o FULL JOIN e USING (user_id, event_type) WHERE user_id IS NOT NULL GROUP BY 1 HAVING sum(o * o) > 0",
)
def cd_distance_by_condition(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    found = windows.distance_by_condition(events, events.groupBy("user_id", "event_type").count(), "user_id", "event_type", "value", "SizeWeighted")
    return found.select("user_id", F.round("score", 6).alias("score"))


for _s, _sql in {"none": "dot", "independent": "dot / sqrt(oo * ee)", "sizeweighted": "2 * dot / (oo + ee)"}.items():

    @query(
        f"cd_windowed_distance_{_s}",
        "WITH e AS (SELECT event_type, count(*) * 1.0 AS e FROM events GROUP BY 1), s AS (SELECT sum(e * e) AS ee FROM e), w AS (SELECT event_id, sum(e) OVER w AS dot, histogram(event_type) OVER w AS h FROM events JOIN e USING (event_type) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING)), "
        f"q AS (SELECT event_id, CAST(dot AS DOUBLE) AS dot, list_sum(list_transform(map_values(h), lambda x: x * x)) AS oo FROM w) SELECT event_id, round(CAST({_sql} AS DOUBLE), 6) AS score FROM q, s",
    )
    def _windowed(spark: SparkSession, d: str, _s: str = _s) -> DataFrame:
        events = table(spark, d, "events").where("event_type is not null")
        expected = events.groupBy(F.col("event_type").alias("bin")).count()
        scheme = {"none": None, "independent": "Independent", "sizeweighted": "SizeWeighted"}[_s]
        return windows.windowed_distance(events.select("event_id", "user_id", "event_type"), "event_type", expected, 20, ("user_id",), ("event_id",), "score", scheme).select("event_id", F.round("score", 6).alias("score"))


@query("win_exponential_variance", "WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL), r AS (SELECT event_id, user_id, k, CAST(value AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.k, 0.2 * o.value + 0.8 * r.m, 0.8 * (r.v + 0.2 * (o.value - r.m) * (o.value - r.m)) FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT event_id, round(m + 0.000000314159, 5) AS mean, round(v + 0.000000314159, 4) AS variance FROM r")
def win_exponential_variance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value is not null").select("event_id", "user_id", "value")
    out = windows.exponential(rows, "value", 0.2, ("user_id",), ("event_id",), "mean", "variance")
    return out.select("event_id", F.round(F.col("mean") + 0.000000314159, 5).alias("mean"), F.round(F.col("variance") + 0.000000314159, 4).alias("variance"))


# --- scorers ---------------------------------------------------------------------------------------------------------


_TARGET = "<MiningSchema><MiningField name='x'/><MiningField name='t' usageType='predicted' optype='ordinal'/></MiningSchema>"
_CUTS = {"low": -0.5, "mid": 0.4, "high": 0.0}
_LOGIT = {c: f"1 / (1 + exp(-({v} + 0.05 * x)))" for c, v in _CUTS.items()}


def _regressions(norm: str, schema: str, fields: str = _EVENT_FIELDS) -> ir.Node:
    tables_ = "".join(f"<RegressionTable intercept='{v}' targetCategory='{c}'><NumericPredictor name='x' coefficient='0.05'/></RegressionTable>" for c, v in _CUTS.items())
    return document(f"<RegressionModel functionName='classification' normalizationMethod='{norm}'>{schema}{tables_}</RegressionModel>", fields)


@query("model_classification_ordinal", f"{_CTE} SELECT event_id, round({_LOGIT['low']}, 6) AS low, round({_LOGIT['mid']} - {_LOGIT['low']}, 6) AS mid, round(1 - {_LOGIT['mid']}, 6) AS high FROM e")
def model_classification_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal targets: the links give cumulative probabilities, their differences those of the classes."""
    out = models.score(frame(spark, d), _regressions("logit", _TARGET), ("event_id",), tuple(f"probability:{c}" for c in _CUTS))
    return out.select("event_id", *[F.round(f"probability_{c}", 6).alias(c) for c in _CUTS])


@query("model_classification_probit")
def model_classification_probit(spark: SparkSession, d: str) -> DataFrame:
    """DuckDB has no normal distribution; a unit test compares all rows with the standard library's."""
    return models.score(frame(spark, d), _regressions("probit", "<MiningSchema><MiningField name='x'/></MiningSchema>"), ("event_id",), ("probability:low", "probability:mid"))


_BASE = "<BaselineModel functionName='regression'><MiningSchema><MiningField name='x'/></MiningSchema><TestDistributions field='x' testStatistic='zValue'><Baseline><GaussianDistribution mean='10' variance='400'/></Baseline></TestDistributions></BaselineModel>"


@query("model_from_json", f"{_CTE} SELECT event_id, round((x - 10) / 20, 6) AS score FROM e")
def model_from_json(spark: SparkSession, d: str) -> DataFrame:
    """The same model through the JSON rendering of its document."""
    doc = ir.load(ir.to_json(document(_BASE, _EVENT_FIELDS)))
    return models.score(frame(spark, d), doc, ("event_id",)).withColumn("score", F.round("score", 6))


for _n, _where, _sql in (("like", "w like 'c.*'", "w LIKE 'c%'"), ("in", "k in {1, 2}", "k IN (1, 2)"), ("not_in", "isNotIn(k, 1, 2)", "k NOT IN (1, 2)"), ("between", "x between 0 and 50", "x BETWEEN 0 AND 50")):

    @query(f"agg_model_where_{_n}", f"{_CTE} SELECT event_id, round(CAST(coalesce(sum(CASE WHEN {_sql} THEN x END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE), 3) AS r FROM e")
    def _where_query(spark: SparkSession, d: str, _where: str = _where) -> DataFrame:
        text = _where.replace("&", "&amp;").replace("<", "&lt;").replace("'", "&apos;")
        doc = document("", _EVENT_FIELDS, f"<DerivedField name='r'><Aggregate field='x' function='sum' sqlWhere='{text}'/></DerivedField>")
        return models.transform(frame(spark, d), doc, ("r",), ("event_id",), order_by=("event_id",)).withColumn("r", F.round("r", 3))


# --- table verbs, tools and hooks ----------------------------------------------------------------------------------


@query("tbl_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 END AS doubled FROM orders")
def tbl_update(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("doubled"))
    return tables.update(orders, other, ("o_orderkey",)).drop("o_totalprice")


@query("tbl_fill", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE' UNION ALL SELECT NULL, 'ELSEWHERE'")
def tbl_fill(spark: SparkSession, d: str) -> DataFrame:
    return tables.fill(table(spark, d, "region").select("r_regionkey", "r_name"), [{"r_regionkey": 99, "r_name": "NOWHERE"}, {"r_name": "ELSEWHERE"}])


@query("tbl_resize", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def tbl_resize(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 rows, which is the feature."""
    return tables.resize(table(spark, d, "events").select("event_id", "event_type"), ("event_id",), 100)


@query("agg_gini_joint", "WITH a AS (SELECT l_returnflag AS v, count(*) * 1.0 AS n FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS v, count(*) * 1.0 AS n FROM lineitem GROUP BY 1) SELECT round(((SELECT sum(n) * (1 - sum(n * n) / pow(sum(n), 2)) FROM a) + (SELECT sum(n) * (1 - sum(n * n) / pow(sum(n), 2)) FROM b)) / ((SELECT sum(n) FROM a) + (SELECT sum(n) FROM b)), 9) AS gini")
def agg_gini_joint(spark: SparkSession, d: str) -> DataFrame:
    return tables.gini_joint(_lines(spark, d), "l_returnflag", "l_linestatus").select(F.round("gini", 9).alias("gini"))


@query("tool_score_differences", "SELECT event_id, 'score' AS field FROM events WHERE event_id % 7 = 0 AND value IS NOT NULL AND abs(value) > 0.001")
def tool_score_differences(spark: SparkSession, d: str) -> DataFrame:
    """Score files that differ beyond eight digits in one row of seven, and below them everywhere."""
    rows = table(spark, d, "events").select("event_id", F.col("value").cast("double").alias("score"))
    moved = rows.withColumn("score", F.when((F.col("event_id") % 7 == 0) & (F.abs("score") > 0.001), F.col("score") * 1.01).otherwise(F.col("score") * (1 + 1e-14)))
    paths = [scratch(spark, "scores") for _ in range(2)]
    for frame_, path in zip((rows, moved), paths, strict=True):
        files.write_scores(frame_, path)
    a, b = (files.read_scores(spark, p, "event_id bigint, score double") for p in paths)
    return tables.score_differences(a, b, ("event_id",)).select("event_id", "field")


@query("hook_registered_function", "SELECT event_id, round(CAST(value AS DOUBLE) * 2 + user_id, 6) AS r FROM events")
def hook_registered_function(spark: SparkSession, d: str) -> DataFrame:
    """A function of the user's, called from a formula of the table language."""
    hooks.register("twicePlus", lambda a, b: a * 2 + b, model=False)
    try:
        return table(spark, d, "events").select("event_id", F.round(formula.compile_plain(formula.parse("twicePlus(value, user_id)")).cast("double"), 6).alias("r"))
    finally:
        hooks.unregister("twicePlus")


@query("hook_vectorised_function", "SELECT event_id, reverse(event_type) AS r FROM events")
def hook_vectorised_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", hooks.vectorised(lambda s: s[::-1], "string")(F.col("event_type")).alias("r"))


class _Counting(hooks.Hooks):
    """Counts and adds up the rows of a partition and reports at its end."""

    def begin(self) -> None:
        self.seen, self.total = 0, 0.0

    def event(self, rows: pd.DataFrame) -> None:
        self.seen += len(rows)
        self.total += float(rows["value"].fillna(0).sum())

    def end(self) -> pd.DataFrame:
        return pd.DataFrame({"n": [self.seen], "total": [self.total]})


@query("hook_custom_processing", "SELECT count(*) AS n, round(sum(value), 3) AS total FROM events")
def hook_custom_processing(spark: SparkSession, d: str) -> DataFrame:
    parts = hooks.process(table(spark, d, "events").select("value"), _Counting, "n long, total double")
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))
