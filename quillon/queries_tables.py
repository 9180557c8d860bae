"""Queries of aggregates, windows, change detection, table verbs and plot data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import mapreduce, segments, tables, windows
from quillon.plans import ir
from quillon.plans import models
from quillon.queries_functions import _CTE, frame
from quillon.queries_models import _EVENT_FIELDS, document
from quillon.registry import query
from quillon.session import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")


def _off(name: str, digits: int = 5) -> Column:
    """Rounded a little off, as means of prices end on a half where engines round differently."""
    return F.round(F.col(name).cast("double") + 0.000000314159, digits).alias(name)


_BY, _ORDER = ("user_id",), ("event_id",)
_E = "events"
_W = "PARTITION BY user_id ORDER BY event_id"

# --- running aggregates --------------------------------------------------------------------------------------

for _n, _sql in {"count": "count(value)", "sum": "coalesce(sum(value), 0)", "average": "avg(value)", "min": "min(value)", "max": "max(value)"}.items():

    @query(f"agg_running_{_n}", f"SELECT event_id, round(CAST({_sql.replace(')', f') OVER ({_W} ROWS UNBOUNDED PRECEDING)', 1) if _n != 'sum' else f'sum(value) OVER ({_W} ROWS UNBOUNDED PRECEDING)'} AS DOUBLE) + 0.000000314159, 5) AS r FROM {_E}")
    def _run(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        return windows.running(_events(spark, d), F.col("value"), _n, _BY, _ORDER, "r").select("event_id", _off("r"))


@query("agg_model_grouped", f"{_CTE}, g AS (SELECT event_id, w, CASE WHEN x IS NOT NULL AND x > -20 THEN x END AS v FROM e) SELECT event_id, round(coalesce(sum(v) OVER (PARTITION BY w ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS r FROM g")
def agg_model_grouped(spark: SparkSession, d: str) -> DataFrame:
    doc = document("", _EVENT_FIELDS, "<DerivedField name='r'><Aggregate field='x' function='sum' groupField='w' sqlWhere='x &gt; -20'/></DerivedField>")
    return models.transform(frame(spark, d), doc, ("r",), ("event_id",), order_by=("event_id",)).withColumn("r", F.round("r", 4))


@query("agg_multiset", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def agg_multiset(spark: SparkSession, d: str) -> DataFrame:
    return windows.multiset(_events(spark, d), "user_id", "event_type").select("user_id", F.explode("multiset").alias("event_type", "n"))


@query("agg_reduce", "SELECT round(max(s), 4) AS value FROM (SELECT sum(value) AS s FROM events GROUP BY user_id)")
def agg_reduce(spark: SparkSession, d: str) -> DataFrame:
    return windows.aggregate_reduce(_events(spark, d), "user_id", F.col("value"), "sum", "max").select(F.round("value", 4).alias("value"))


@query("agg_global_prefix", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS r FROM events")
def agg_global_prefix(spark: SparkSession, d: str) -> DataFrame:
    return windows.prefix_sum(_events(spark, d), F.col("value"), ("event_id",), "r").select("event_id", F.round("r", 3).alias("r"))


@query("agg_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, round(covar_pop(value, user_id), 6) AS covariance, round(regr_slope(value, user_id), 8) AS slope FROM events GROUP BY 1")
def agg_moments(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 6).alias("variance"), F.round(F.covar_pop("value", "user_id"), 6).alias("covariance"), F.round(F.regr_slope("value", "user_id"), 8).alias("slope"))


@query("agg_histogram", "WITH b AS (SELECT least(CAST(floor(value / 25) AS INTEGER), 19) AS bin, count(*) * 1.0 AS weight FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1) SELECT CAST(r.i AS INTEGER) AS bin, CAST(coalesce(weight, 0) AS DOUBLE) AS weight FROM range(20) r(i) LEFT JOIN b ON b.bin = r.i")
def agg_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tables.histogram(_events(spark, d), F.col("value"), 20, 0.0, 500.0).select("bin", "weight")


@query("agg_value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def agg_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.counts(_events(spark, d), "event_type")


@query("agg_event_count", "SELECT event_id, round(sum(value) OVER (PARTITION BY event_type), 2) AS event_count FROM events")
def agg_event_count(spark: SparkSession, d: str) -> DataFrame:
    return tables.segment_counts(_events(spark, d), "event_type", "value").select("event_id", F.round("event_count", 2).alias("event_count"))


@query("agg_gini", "SELECT user_id, round(1 - sum(n * n) / pow(sum(n), 2), 9) AS gini FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def agg_gini(spark: SparkSession, d: str) -> DataFrame:
    return tables.gini(_events(spark, d), "event_type", ("user_id",)).withColumn("gini", F.round("gini", 9))


# --- windows ---------------------------------------------------------------------------------------------------

_MOMENTS = "count(value) OVER w AS w_count, round(avg(value) OVER w + 0.000000314159, 5) AS w_mean, round(var_samp(value) OVER w + 0.000000314159, 5) AS w_var, min(value) OVER w AS w_min, max(value) OVER w AS w_max"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("event_id", "w_count", _off("w_mean"), _off("w_var"), "w_min", "w_max")


@query("win_windowed", f"SELECT event_id, {_MOMENTS} FROM events WINDOW w AS ({_W} ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING)")
def win_windowed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.windowed(_events(spark, d), F.col("value"), 5, 2, _BY, _ORDER))


@query("win_synchronised", "SELECT event_id, count(value) OVER w AS w_count, round(avg(value) OVER w + 0.000000314159, 5) AS w_mean, min(value) OVER w AS w_min, max(value) OVER w AS w_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)")
def win_synchronised(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("sec", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500_000) / 1_000_000))
    return _rounded(windows.synchronised(rows, F.col("value"), "sec", 86_400, 1, _BY)).drop("w_var")


@query("win_unweighted", f"SELECT event_id, {_MOMENTS} FROM events WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)")
def win_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(windows.unweighted(_events(spark, d), F.col("value"), _BY, _ORDER))


@query("win_exponential", f"WITH l AS (SELECT event_id, list(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS v FROM events) SELECT event_id, round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) AS ewma FROM l")
def win_exponential(spark: SparkSession, d: str) -> DataFrame:
    return windows.exponential(_events(spark, d), "value", 0.3, _BY, _ORDER).select("event_id", F.round("ewma", 6).alias("ewma"))


@query("win_shift", f"SELECT event_id, coalesce(lag(value, 2) OVER ({_W}), -1.0) AS back, coalesce(lead(value, 3) OVER ({_W}), -1.0) AS ahead FROM events")
def win_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.shift(_events(spark, d), "value", 2, -1.0, _BY, _ORDER, "back")
    return windows.shift(rows, "value", -3, -1.0, _BY, _ORDER, "ahead").select("event_id", "back", "ahead")


@query("win_delta", f"SELECT event_id, round(coalesce(value - lag(value) OVER ({_W}), 0), 6) AS r FROM events")
def win_delta(spark: SparkSession, d: str) -> DataFrame:
    return windows.delta(_events(spark, d), "value", _BY, _ORDER, "r").select("event_id", F.round("r", 6).alias("r"))


@query("win_carry_forward", f"SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 <> 0 THEN event_id END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0) AS r FROM events")
def win_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).otherwise(0))
    return windows.carry_forward(rows, "v", _BY, _ORDER, "r").select("event_id", "r")


@query("win_look_ahead", "WITH p AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, max(value) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND 10 FOLLOWING) AS v FROM events), s AS (SELECT user_id, value AS v, min(i) AS r FROM p GROUP BY ALL) SELECT event_id, r FROM p JOIN s USING (user_id, v)")
def win_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    return windows.look_ahead(_events(spark, d), "value", 10.0, _BY, True, "r").select("event_id", F.col("r").cast("bigint").alias("r"))


for _kind, _sql in {"sum": "sum(value) OVER f", "range": "max(value) OVER f - min(value) OVER f"}.items():
    _head = {"sum": "sum(value) OVER h", "range": "max(value) OVER h - min(value) OVER h"}[_kind]

    @query(f"win_apply_{_kind}", f"SELECT event_id, r FROM (SELECT event_id, row_number() OVER ({_W}) AS n, round(CASE WHEN row_number() OVER ({_W}) = 4 THEN {_head} ELSE {_sql} END, 6) AS r FROM events WINDOW f AS ({_W} ROWS 3 PRECEDING), h AS ({_W} ROWS 2 PRECEDING)) WHERE n >= 4")
    def _apply(spark: SparkSession, d: str, _kind: str = _kind) -> DataFrame:
        return windows.window_apply(_events(spark, d), "value", 4, _BY, _ORDER, "r", _kind).select("event_id", F.round("r", 6).alias("r"))


@query("win_unique_mask", f"SELECT event_id, coalesce(event_type <> lead(event_type) OVER ({_W}), TRUE) AS last_of_run, coalesce(event_type <> lag(event_type) OVER ({_W}), TRUE) AS first_of_run FROM events")
def win_unique_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.unique_mask(_events(spark, d), "event_type", _BY, _ORDER, True, "last_of_run")
    return windows.unique_mask(rows, "event_type", _BY, _ORDER, False, "first_of_run").select("event_id", "last_of_run", "first_of_run")


@query("win_runs", f"WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER ({_W}) THEN 0 ELSE 1 END AS b FROM events) SELECT event_id, CAST(sum(b) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM s")
def win_runs(spark: SparkSession, d: str) -> DataFrame:
    return windows.runs(_events(spark, d), "event_type", _BY, _ORDER).select("event_id", F.col("run_no").cast("bigint").alias("run_no"))


# --- change detection ----------------------------------------------------------------------------------------------

_STEP = "(value - 60) / 30"


@query("cd_cusum", f"WITH c AS (SELECT event_id, user_id, sum({_STEP}) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT event_id, round(s + greatest(0, -min(s) OVER ({_W} ROWS UNBOUNDED PRECEDING)), 5) AS r FROM c")
def cd_cusum(spark: SparkSession, d: str) -> DataFrame:
    return windows.cusum(_events(spark, d), (F.col("value") - 60) / 30, _BY, _ORDER, "r").select("event_id", F.round("r", 5).alias("r"))


@query("cd_cusum_exact", f"WITH l AS (SELECT event_id, list({_STEP}) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS v FROM events) SELECT event_id, round(list_reduce(list_prepend(0.0, v), lambda a, x: greatest(0.0, a + x)), 5) AS r FROM l")
def cd_cusum_exact(spark: SparkSession, d: str) -> DataFrame:
    return windows.cusum_exact(_events(spark, d).withColumn("v", (F.col("value") - 60) / 30), "v", _BY, _ORDER, "r").select("event_id", F.round("r", 5).alias("r"))


@query("cd_cusum_windowed", f"WITH l AS (SELECT event_id, list({_STEP}) OVER ({_W} ROWS 9 PRECEDING) AS v FROM events) SELECT event_id, round(list_reduce(list_prepend(0.0, v), lambda a, x: greatest(0.0, a + x)), 5) AS r FROM l")
def cd_cusum_windowed(spark: SparkSession, d: str) -> DataFrame:
    return windows.windowed_cusum(_events(spark, d), (F.col("value") - 60) / 30, 10, _BY, _ORDER, "r").select("event_id", F.round("r", 5).alias("r"))


@query("cd_glr", f"WITH l AS (SELECT event_id, list_reverse(list(value) OVER ({_W} ROWS 7 PRECEDING)) AS v FROM events) SELECT event_id, round(list_max(list_transform(range(1, len(v) + 1), lambda n: pow(list_sum(v[1:n]) - n * 50, 2) / n / 4000)) + 0.000000314159, 5) AS glr FROM l")
def cd_glr(spark: SparkSession, d: str) -> DataFrame:
    return windows.glr(_events(spark, d), F.col("value"), 8, _BY, _ORDER, 50.0, 2000.0).select("event_id", _off("glr"))


@query("cd_glr_poisson", f"WITH l AS (SELECT event_id, list_reverse(list(value) OVER ({_W} ROWS 7 PRECEDING)) AS v FROM events) SELECT event_id, round(list_max(list_transform(range(1, len(v) + 1), lambda n: -ln(50) * list_sum(v[1:n]) + ln(list_sum(v[1:n]) / n) * list_sum(v[1:n]) + n * 50 - list_sum(v[1:n]))), 4) AS glr FROM l")
def cd_glr_poisson(spark: SparkSession, d: str) -> DataFrame:
    return windows.glr(_events(spark, d), F.col("value"), 8, _BY, _ORDER, 50.0).select("event_id", F.round("glr", 4).alias("glr"))


_EXPECTED = "(VALUES ('click', 300.0), ('view', 500.0), ('purchase', 100.0), ('other', 10.0)) x(bin, e)"


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _events(spark, d).groupBy(F.col("event_type").alias("bin")).count()
    return o, spark.createDataFrame([("click", 300.0), ("view", 500.0), ("purchase", 100.0), ("other", 10.0)], "bin string, count double")


_BOTH = f"WITH o AS (SELECT event_type AS bin, count(*) AS o FROM events GROUP BY 1), b AS (SELECT coalesce(o, 0) AS o, coalesce(e, 0) AS e FROM o FULL JOIN {_EXPECTED} USING (bin)), t AS (SELECT sum(o) AS ot, sum(e) AS et FROM b) "


@query("cd_chi_square", _BOTH + "SELECT round(sum(pow(e / et - o / ot, 2) / (e / pow(et, 2) + o / pow(ot, 2))), 6) AS chi_square, count(*) - 1 AS ndf FROM b, t WHERE o > 0 OR e > 0")
def cd_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return windows.chi_square(*_observed(spark, d)).select(F.round("chi_square", 6).alias("chi_square"), "ndf")


@query("cd_chi_square_probability")
def cd_chi_square_probability(spark: SparkSession, d: str) -> DataFrame:
    from quillon.functions import special

    out = windows.chi_square(*_observed(spark, d)).withColumn("probability", special.chi_square_cdf(F.col("chi_square"), F.col("ndf")))
    return out.withColumn("p_value", 1 - F.col("probability"))


for _scheme, _sql in {None: "sum(o * e)", "Independent": "sum(o * e) / sqrt(sum(o * o) * sum(e * e))", "SizeWeighted": "2 * sum(o * e) / (sum(o * o) + sum(e * e))"}.items():

    @query(f"cd_scalar_product_{(_scheme or 'none').lower()}", f"{_BOTH} SELECT round(CAST({_sql} AS DOUBLE), 6) AS score FROM b")
    def _sp(spark: SparkSession, d: str, _scheme: str | None = _scheme) -> DataFrame:
        return windows.scalar_product(*_observed(spark, d), _scheme).select(F.round("score", 6).alias("score"))


@query(
    "cd_chi_square_independence",
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) * 1.0 AS n FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) "
    "SELECT round(sum(pow(coalesce(n, 0) - ra * cb / t, 2) / (ra * cb / t)), 6) AS chi_square, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS ndf FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)",
)
def cd_chi_square_independence(spark: SparkSession, d: str) -> DataFrame:
    return windows.chi_square_independence(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("chi_square", 6).alias("chi_square"), "ndf")


@query("cd_thresholds", "SELECT event_id, abs((value - 50) / sqrt(2000.0)) > 2 AS alert FROM events")
def cd_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", (F.abs(windows.z_value(F.col("value"), F.lit(50.0), F.lit(2000.0))) > 2).alias("alert"))


@query(
    "cd_online_zvalue",
    f"WITH m AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS a, var_samp(value) OVER w AS v FROM events WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, round(CASE WHEN n >= 5 AND v > 0 THEN (value - a) / sqrt(v) END, 5) AS score FROM m",
)
def cd_online_zvalue(spark: SparkSession, d: str) -> DataFrame:
    """Score first, then learn: each row is judged by the rows before it, once five are known."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    n, mean, var = F.count("value").over(w), F.avg("value").over(w), F.var_samp("value").over(w)
    rows = _events(spark, d).withColumns({"n": n, "m": mean, "v": F.when(n >= 2, var)})
    return rows.select("event_id", F.round(F.when((F.col("n") >= 5) & (F.col("v") > 0), windows.z_value(F.col("value"), F.col("m"), F.col("v"))), 5).alias("score"))


# --- tables ---------------------------------------------------------------------------------------------------------------


@query("tbl_select", "SELECT event_id AS id, round(value * 2 + 1, 6) AS double_plus, sqrt(value) > 7 AS big FROM events WHERE value > 10 AND value < 60 AND event_type IN ('click', 'view')")
def tbl_select(spark: SparkSession, d: str) -> DataFrame:
    return tables.select(_events(spark, d), "event_id, value * 2 + 1, sqrt(value) > 7", ("id", "double_plus", "big"), "10 < value < 60, event_type in {'click', 'view'}").withColumn("double_plus", F.round("double_plus", 6))


@query("tbl_add_index", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS row_no FROM events")
def tbl_add_index(spark: SparkSession, d: str) -> DataFrame:
    return tables.add_index(_events(spark, d), ("value", "event_id")).select("event_id", "row_no")


@query("tbl_slice", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 10 AND i < 900 AND (i - 10) % 7 = 0")
def tbl_slice(spark: SparkSession, d: str) -> DataFrame:
    return tables.slice_rows(_events(spark, d), ("event_id",), 10, 900, 7).select("event_id")


@query("tbl_sorted", "SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC")
def tbl_sorted(spark: SparkSession, d: str) -> DataFrame:
    return tables.sorted_on(_events(spark, d), "value", ("event_id",), True).select("event_id", "value")


@query("tbl_take", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) JOIN (VALUES (3), (3), (17), (400)) v(i) USING (i)")
def tbl_take(spark: SparkSession, d: str) -> DataFrame:
    places = spark.createDataFrame([(3,), (3,), (17,), (400,)], "row_no long")
    return tables.take(_events(spark, d), ("event_id",), places).select("event_id")


@query("tbl_expand", "SELECT event_id FROM (SELECT event_id, unnest(range(0, event_id % 4)) FROM events)")
def tbl_expand(spark: SparkSession, d: str) -> DataFrame:
    return tables.expand(_events(spark, d).select("event_id", (F.col("event_id") % 4).alias("n")), "n")


@query("tbl_extend", "SELECT r_regionkey AS k, r_name AS name, NULL::INTEGER AS n_regionkey FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tbl_extend(spark: SparkSession, d: str) -> DataFrame:
    return tables.extend(table(spark, d, "region").toDF("k", "name"), table(spark, d, "nation").toDF("k", "name", "n_regionkey"))


@query("tbl_difference", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS left, 'X' AS right FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'X'")
def tbl_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")))
    return tables.difference(a, b, ("o_orderkey",))


@query("tbl_multiset_difference", "SELECT n_regionkey, 'left' AS side FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)")
def tbl_multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    return tables.multiset_difference(table(spark, d, "nation").select("n_regionkey"), table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")))


@query("tbl_top_by_field", "WITH s AS (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS count FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL) SELECT field, value, count FROM (SELECT *, rank() OVER (PARTITION BY field ORDER BY count DESC) AS r FROM s WHERE value IS NOT NULL) WHERE r <= 10")
def tbl_top_by_field(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_by_field(table(spark, d, "part"), ("p_brand", "p_type"), 10)


@query("tbl_sample")
def tbl_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    return tables.sample(_events(spark, d), 100, "event_id").select("event_id")


@query("tbl_dict_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS kept, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE '?' END AS other FROM events")
def tbl_dict_map(spark: SparkSession, d: str) -> DataFrame:
    m = {"click": "c", "view": "v"}
    return _events(spark, d).select("event_id", tables.dict_map(F.col("event_type"), m).alias("kept"), tables.dict_map(F.col("event_type"), m, "?", False).alias("other"))


@query("tbl_vector_bins", "SELECT event_id, (value > 10)::INT + (value > 50)::INT + (value > 90)::INT AS bin, CAST(floor((value - 5) / 12.5) AS BIGINT) AS linear, greatest(20, least(80, value)) AS capped FROM events")
def tbl_vector_bins(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    return _events(spark, d).select("event_id", tables.discretize(x, (10, 50, 90)).alias("bin"), tables.linear_bins(x, 5, 12.5).alias("linear"), tables.range_cap(x, 20.0, 80.0).alias("capped"))


_SEGS = "(VALUES ('s1', 'click', 0.0, 40.0), ('s2', 'click', 30.0, 90.0), ('s3', 'view', 10.0, 500.0)) s(seg, kind, lo, hi)"


@query("join_segments", f"SELECT event_id, seg FROM events JOIN {_SEGS} ON event_type = kind AND value >= lo AND value < hi")
def join_segments(spark: SparkSession, d: str) -> DataFrame:
    segs = spark.createDataFrame([("s1", "click", 0.0, 40.0), ("s2", "click", 30.0, 90.0), ("s3", "view", 10.0, 500.0)], "seg string, kind string, lo double, hi double")
    return tables.match_segments(_events(spark, d), segs, "lo", "hi", "value", {"event_type": "kind"}).select("event_id", "seg")


for _n, _not in {"black": "NOT IN", "white": "IN"}.items():

    @query(f"join_{_n}list", f"SELECT event_id, event_type FROM events WHERE event_type {_not} ('click', 'view')")
    def _list(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        names = spark.createDataFrame([("click",), ("view",)], "event_type string")
        return tables.listed(_events(spark, d), names, "event_type", _n == "black").select("event_id", "event_type")


@query("join_star", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_star(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, customers, nations = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- plot data ------------------------------------------------------------------------------------------------------------------


@query(
    "plot_histogram",
    "WITH r AS (SELECT CAST(min(value) AS DOUBLE) AS a, CAST(max(value) AS DOUBLE) AS b, count(value) AS n, quantile_cont(CAST(value AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(value AS DOUBLE), 0.75) AS q3 FROM events), l AS (SELECT a - 0.2 * (b - a) / 2 AS low, b + 0.2 * (b - a) / 2 AS high, 2 * (q3 - q1) / pow(n, 1.0 / 3) AS width FROM r), k AS (SELECT low, high, greatest(1, CAST(trunc((high - low) / width) AS BIGINT)) AS bins FROM l), "
    "c AS (SELECT least(CAST(floor((value - low) / ((high - low) / bins)) AS BIGINT), bins - 1) AS bin, count(*) * 1.0 AS w FROM events, k WHERE value BETWEEN low AND high GROUP BY 1) "
    "SELECT CAST(i.bin AS INTEGER) AS bin, round(low + i.bin * ((high - low) / bins), 6) AS low, round(low + (i.bin + 1) * ((high - low) / bins), 6) AS high, CAST(coalesce(w, 0) AS DOUBLE) AS weight FROM (SELECT unnest(range(0, bins)) AS bin FROM k) i CROSS JOIN k LEFT JOIN c ON c.bin = i.bin",
)
def plot_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    low, high, bins = tables.freedman_diaconis(rows, "value")
    return tables.histogram(rows, F.col("value"), bins, low, high).withColumns({c: F.round(c, 6) for c in ("low", "high")})


for _n, _sql in {"count": "count(*)", "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)"}.items():

    @query(f"plot_heat_map_{_n}", f"SELECT least(CAST(floor(l_quantity / 5) AS INTEGER), 9) AS x_bin, least(CAST(floor(l_tax / 0.016) AS INTEGER), 4) AS y_bin, round(CAST({_sql} AS DOUBLE), 4) AS value FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_tax BETWEEN 0 AND 0.08 GROUP BY ALL")
    def _heat(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        out = tables.heat_map(table(spark, d, "lineitem"), "l_quantity", "l_tax", (10, 5), (0.0, 50.0, 0.0, 0.08), None if _n == "count" else "l_extendedprice", _n == "mean")
        return out.withColumn("value", F.round("value", 4))


@query("plot_box_whole", "SELECT least(CAST(floor((user_id - lo) / ((hi - lo) / 8)) AS INTEGER), 7) AS slice, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events, (SELECT min(user_id) AS lo, max(user_id) AS hi FROM events) WHERE user_id IS NOT NULL GROUP BY 1")
def plot_box_whole(spark: SparkSession, d: str) -> DataFrame:
    out = tables.box_and_whisker(_events(spark, d), "user_id", "value", slices=8)
    return out.select("slice", *[F.round(F.col("levels")[k], 6).alias(f"q{k}") for k in (1, 2, 3)])


@query("plot_curve", "SELECT round(CAST(i * 0.1 AS DOUBLE), 6) AS x, round(sin(i * 0.1) * 2 + 1, 6) AS y FROM range(101) r(i)")
def plot_curve(spark: SparkSession, d: str) -> DataFrame:
    return tables.curve(spark, "sin(x) * 2 + 1", 0, 10, 101).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("plot_scatter", "SELECT user_id AS x, value AS y FROM events WHERE event_type = 'click'")
def plot_scatter(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'click'").select(F.col("user_id").alias("x"), F.col("value").alias("y"))


# --- state, segmentation, map and reduce -----------------------------------------------------------------------


@query("agg_continued", f"SELECT event_id, count(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run_count, round(sum(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) + 0.000000314159, 5) AS run_sum FROM events")
def agg_continued(spark: SparkSession, d: str) -> DataFrame:
    """Two batches one after the other, the second going on from the first one's state."""
    rows = _events(spark, d)
    first, second = rows.where("event_id <= 5000"), rows.where("event_id > 5000")
    a, state = windows.continued(first, F.col("value"), _BY, _ORDER)
    b, _ = windows.continued(second, F.col("value"), _BY, _ORDER, state)
    return a.unionByName(b).select("event_id", "run_count", _off("run_sum"))


@query("cd_top_contribution", f"WITH o AS (SELECT event_type AS bin, count(*) AS o FROM events GROUP BY 1) SELECT arg_max(bin, o * e) AS bin, CAST(max(o * e) AS DOUBLE) AS part FROM o JOIN {_EXPECTED} USING (bin)")
def cd_top_contribution(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_contribution(*_observed(spark, d))


_SCHEMA = (
    "<SegmentationSchema><BlacklistedSegments><EnumeratedDimension field='event_type'><Selection value='signup'/></EnumeratedDimension></BlacklistedSegments>"
    "<WhitelistedSegments><EnumeratedDimension field='event_type'><Selection value='click'/></EnumeratedDimension><PartitionedDimension field='value'><Partition low='0' high='100' divisions='4'/></PartitionedDimension></WhitelistedSegments>"
    "<GenericSegment><EnumeratedDimension field='event_type'/></GenericSegment></SegmentationSchema>"
)


@query(
    "stream_segmentation",
    "SELECT event_id, CASE WHEN event_type = 'click' AND value >= 0 AND value < 100 THEN concat('event_type=click,value=0..100#', CAST(floor(value / 25) AS INTEGER)) ELSE concat('event_type=', event_type) END AS segment FROM events WHERE event_type <> 'signup'",
)
def stream_segmentation(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_key(_events(spark, d), ir.load(_SCHEMA)).select("event_id", "segment")


@query("stream_maturity", f"SELECT event_id, CASE WHEN row_number() OVER ({_W}) > 3 THEN round((value - 50) / sqrt(2000.0), 6) END AS score FROM events")
def stream_maturity(spark: SparkSession, d: str) -> DataFrame:
    z = segments.zero_variance(F.col("value"), F.lit(50.0), F.lit(2000.0))
    return segments.mature(_events(spark, d), "user_id", ["event_id"], 3, F.round(z, 6)).select("event_id", "score")


@query("agg_map_reduce", "SELECT event_type AS key, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1")
def agg_map_reduce(spark: SparkSession, d: str) -> DataFrame:
    shrink = lambda g: g.groupby("key", as_index=False).agg({"total": "sum", "n": "sum"})
    made = mapreduce.map_reduce(_events(spark, d).select("event_type", "value"), lambda f: f.rename(columns={"event_type": "key", "value": "total"}).assign(n=1), "key string, total double, n long", shrink, "key string, total double, n long", "key", shrink)
    return made.withColumn("total", F.round("total", 2))


@query("agg_grouped_view", "SELECT n_nationkey, n_regionkey AS g, CAST(sum(CASE WHEN n_regionkey = 2 THEN n_nationkey END) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS two FROM nation")
def agg_grouped_view(spark: SparkSession, d: str) -> DataFrame:
    made = windows.grouped_view(table(spark, d, "nation"), "n_regionkey", F.col("n_nationkey"), ("n_nationkey",), "m")
    return made.select("n_nationkey", F.col("n_regionkey").alias("g"), F.try_element_at("m", F.lit(2)).cast("bigint").alias("two"))


@query("tbl_rules", "SELECT event_id, round(value * 2, 6) AS twice, round(value * 2 + 1, 6) AS more, value * 2 + 1 > 100 AS big FROM events")
def tbl_rules(spark: SparkSession, d: str) -> DataFrame:
    made = tables.apply_rules(_events(spark, d), {"big": "more > 100", "more": "twice + 1", "twice": "value * 2"})
    return made.select("event_id", F.round("twice", 6).alias("twice"), F.round("more", 6).alias("more"), "big")
