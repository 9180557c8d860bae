"""Queries of trainers, streams and file formats."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import ir, models
from quillon.queries_models import _LINE_KEY
from quillon.registry import query
from quillon.session import scratch as _scratch
from quillon.session import table
from quillon.sources import files
from quillon.streaming import online
from quillon.train import trainers

_KEY = ", ".join(_LINE_KEY)



def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


@query("train_moments", "SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def train_moments(spark: SparkSession, d: str) -> DataFrame:
    return trainers.moments(_lines(spark, d), "l_quantity", ("l_returnflag",)).withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query("train_moments_weighted", "SELECT l_returnflag, round(sum(l_tax * l_quantity) / sum(l_tax), 6) AS mean FROM lineitem GROUP BY 1")
def train_moments_weighted(spark: SparkSession, d: str) -> DataFrame:
    return trainers.moments(_lines(spark, d), "l_quantity", ("l_returnflag",), "l_tax").select("l_returnflag", F.round("mean", 6).alias("mean"))


@query("train_count_table", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS count FROM lineitem GROUP BY ALL")
def train_count_table(spark: SparkSession, d: str) -> DataFrame:
    return trainers.count_table(_lines(spark, d), ("l_returnflag", "l_linestatus"))


@query("train_then_score", f"WITH m AS (SELECT l_returnflag, avg(l_quantity) AS a, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT {_KEY}, round((l_quantity - a) / sqrt(v), 6) AS score FROM lineitem JOIN m USING (l_returnflag)")
def train_then_score(spark: SparkSession, d: str) -> DataFrame:
    doc = trainers.baseline_document(_lines(spark, d), "l_quantity", "l_returnflag")
    return models.score(_lines(spark, d), ir.load(ir.to_xml(doc)), _LINE_KEY).withColumn("score", F.round("score", 6))


@query("train_regression", "SELECT count(*) AS rows, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def train_regression(spark: SparkSession, d: str) -> DataFrame:
    fit = trainers.least_squares(_lines(spark, d), "l_extendedprice", ("l_quantity",))[0]
    return spark.createDataFrame([(fit["rows"], round(fit["intercept"], 4), round(fit["l_quantity"], 6))], "rows long, intercept double, slope double")


@query("train_bayes_counts", "SELECT 'l_linestatus' AS field, l_linestatus AS value, l_returnflag AS target, count(*) AS count FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_returnflag', l_returnflag, l_returnflag, count(*) FROM lineitem GROUP BY ALL")
def train_bayes_counts(spark: SparkSession, d: str) -> DataFrame:
    return trainers.bayes_counts(_lines(spark, d), "l_returnflag", ("l_linestatus",))


@query(
    "train_bayes_score",
    "WITH p AS (SELECT l_linestatus AS v, l_returnflag AS t, count(*) * 1.0 AS n FROM lineitem GROUP BY ALL), t AS (SELECT t, sum(n) AS n FROM p GROUP BY 1), v AS (SELECT DISTINCT v FROM p), l AS (SELECT v.v, t.t, CAST(coalesce(p.n, t.n * 0.001) AS DOUBLE) AS l FROM v CROSS JOIN t LEFT JOIN p ON p.v = v.v AND p.t = t.t), "
    f"s AS (SELECT v, arg_max(t, l) AS score, max(CASE WHEN t = 'R' THEN l END) / sum(l) AS probability_R FROM l GROUP BY 1) SELECT {_KEY}, score, round(probability_R, 9) AS \"probability_R\" FROM lineitem JOIN s ON l_linestatus = v",
)
def train_bayes_score(spark: SparkSession, d: str) -> DataFrame:
    doc = trainers.bayes_document(_lines(spark, d), "l_returnflag", ("l_linestatus",))
    return models.score(_lines(spark, d), doc, _LINE_KEY, ("probability:R",)).withColumn("probability_R", F.round("probability_R", 9))


_START = ((10.0, 0.02), (25.0, 0.05), (40.0, 0.08))
_D = ["pow(l_quantity - {}, 2) + pow(l_discount - {}, 2)".format(*c) for c in _START]


@query("train_kmeans_round", f"SELECT CASE WHEN {_D[0]} <= least({_D[1]}, {_D[2]}) THEN 0 WHEN {_D[1]} <= {_D[2]} THEN 1 ELSE 2 END AS cluster, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 6) AS a, round(avg(l_discount), 6) AS b FROM lineitem GROUP BY 1")
def train_kmeans_round(spark: SparkSession, d: str) -> DataFrame:
    found = trainers.k_means(_lines(spark, d), ("l_quantity", "l_discount"), _START, 1)
    return spark.createDataFrame([(k, n, round(c[0], 6), round(c[1], 6)) for k, (c, n) in enumerate(zip(found.centers, found.counts, strict=True))], "cluster int, n double, a double, b double")


@query("train_kmeans")
def train_kmeans(spark: SparkSession, d: str) -> DataFrame:
    found = trainers.k_means_trials(_lines(spark, d), ("l_quantity", "l_discount"), 4, 2, most_iterations=8)
    return models.score(_lines(spark, d), trainers.clustering_document(found, ("l_quantity", "l_discount")), _LINE_KEY, ("affinity",))


_H = "-(CASE WHEN {a} > 0 THEN {a} / {t} * log2({a} / {t}) ELSE 0 END + CASE WHEN {t} - {a} > 0 THEN ({t} - {a}) / {t} * log2(({t} - {a}) / {t}) ELSE 0 END)"


@query(
    "train_split_gain",
    "WITH r AS (SELECT o_orderpriority AS v, (o_orderstatus = 'F')::INT * 1.0 AS y FROM orders), t AS (SELECT count(*) * 1.0 AS t, sum(y) AS a FROM r), g AS (SELECT v, count(*) * 1.0 AS l, sum(y) AS al FROM r GROUP BY 1) "
    f"SELECT v AS cut, round({_H.format(a='a', t='t')} - (l / t * {_H.format(a='al', t='l')} + (t - l) / t * {_H.format(a='(a - al)', t='(t - l)')}), 9) AS gain, CAST(l AS BIGINT) AS rows_left FROM g, t",
)
def train_split_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit("n").alias("node"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("y"))
    return trainers.split_gains(rows, "node", "y", (), ("o_orderpriority",)).select("cut", F.round("gain", 9).alias("gain"), "rows_left")


@query(
    "train_split_gain_numeric",
    "WITH r AS (SELECT l_quantity AS v, (l_returnflag = 'R')::INT * 1.0 AS y FROM lineitem), t AS (SELECT count(*) * 1.0 AS t, sum(y) AS a FROM r), s AS (SELECT v, count(*) * 1.0 AS n, sum(y) AS yn FROM r GROUP BY 1), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS up, sum(n) OVER (ORDER BY v) AS l, sum(yn) OVER (ORDER BY v) AS al FROM s) "
    f"SELECT (v + up) / 2 AS cut, round({_H.format(a='a', t='t')} - (l / t * {_H.format(a='al', t='l')} + (t - l) / t * {_H.format(a='(a - al)', t='(t - l)')}), 9) AS gain FROM g, t WHERE up IS NOT NULL",
)
def train_split_gain_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(F.lit("n").alias("node"), "l_quantity", (F.col("l_returnflag") == "R").alias("y"))
    return trainers.split_gains(rows, "node", "y", ("l_quantity",), ()).select(F.col("cut").cast("double").alias("cut"), F.round("gain", 9).alias("gain"))


_G = "({t} - ({a} * {a} + ({t} - {a}) * ({t} - {a})) / {t})"


@query(
    "train_split_gain_gini",
    "WITH r AS (SELECT o_orderpriority AS v, (o_orderstatus = 'F')::INT * 1.0 AS y FROM orders), t AS (SELECT count(*) * 1.0 AS t, sum(y) AS a FROM r), g AS (SELECT v, count(*) * 1.0 AS l, sum(y) AS al FROM r GROUP BY 1) "
    f"SELECT v AS cut, round(({_G.format(a='a', t='t')} - {_G.format(a='al', t='l')} - {_G.format(a='(a - al)', t='(t - l)')}) / t, 12) AS gain FROM g, t",
)
def train_split_gain_gini(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit("n").alias("node"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("y"))
    return trainers.split_gains(rows, "node", "y", (), ("o_orderpriority",), impurity="gini").select("cut", F.round("gain", 12).alias("gain"))


@query(
    "train_split_gain_regression",
    "WITH s AS (SELECT l_tax AS v, count(*) * 1.0 AS n, sum(l_quantity) AS a, sum(l_quantity * l_quantity) AS b FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b FROM s), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS up, sum(n) OVER (ORDER BY v) AS n, sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b FROM s) "
    "SELECT round((v + up) / 2, 9) AS cut, round((t.b - t.a * t.a / t.n) - (g.b - g.a * g.a / g.n) - ((t.b - g.b) - (t.a - g.a) * (t.a - g.a) / (t.n - g.n)), 3) AS gain FROM g, t WHERE up IS NOT NULL",
)
def train_split_gain_regression(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(F.lit("n").alias("node"), "l_tax", "l_quantity")
    return trainers.regression_gains(rows, "node", "l_quantity", ("l_tax",), ()).select(F.round(F.col("cut").cast("double"), 9).alias("cut"), F.round("gain", 3).alias("gain"))


@query("train_tree_regression")
def train_tree_regression(spark: SparkSession, d: str) -> DataFrame:
    doc = trainers.grow_tree(_lines(spark, d), "l_extendedprice", ("l_quantity", "l_discount"), ("l_returnflag",), depth=3, regression=True)
    return models.score(_lines(spark, d), doc, _LINE_KEY, ("entityId",))


def _tree(spark: SparkSession, d: str) -> ir.Node:
    return trainers.grow_tree(_lines(spark, d), "l_returnflag", ("l_quantity", "l_extendedprice"), ("l_linestatus",), depth=3, least_gain=1e-5)


@query("train_tree")
def train_tree(spark: SparkSession, d: str) -> DataFrame:
    return models.score(_lines(spark, d), _tree(spark, d), _LINE_KEY, ("entityId", "confidence"))


@query("train_rules")
def train_rules(spark: SparkSession, d: str) -> DataFrame:
    return models.score(_lines(spark, d), trainers.rule_set(_tree(spark, d)), _LINE_KEY)


# --- streams ---------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: one file in a folder of its own, as file streams read folders."""
    kept = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = _scratch(spark, "events")
    kept.write.parquet(path)
    return spark.readStream.schema(kept.schema).parquet(path)


@query("stream_pseudo_events", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(value) AS n, round(sum(value), 3) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def stream_pseudo_events(spark: SparkSession, d: str) -> DataFrame:
    made = online.pseudo_events(_stream(spark, d), "ts", "6 hours", "value", ("event_type",))
    return online.completed(made, _scratch(spark, "pseudo")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"), "low", "high")


@query("stream_counted_events", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS batch_no FROM events) SELECT user_id, batch_no, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY ALL")
def stream_counted_events(spark: SparkSession, d: str) -> DataFrame:
    return online.counted_pseudo_events(table(spark, d, "events"), 10, ("event_id",), ("user_id",), "value").withColumn("total", F.round("total", 4))


@query(
    "stream_online_zvalue",
    "WITH m AS (SELECT event_id, user_id, value, count(value) OVER w AS k, avg(value) OVER w AS a, var_samp(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, round(CASE WHEN k >= 5 AND v > 0 THEN (value - a) / sqrt(v) END, 5) AS z, k + 1 AS n FROM m",
)
def stream_online_zvalue(spark: SparkSession, d: str) -> DataFrame:
    made = online.online_z_values(_stream(spark, d), "user_id", "event_id", "value")
    return online.drain(made, _scratch(spark, "online")).withColumn("z", F.round("z", 5))


@query("stream_learning", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance FROM events GROUP BY 1")
def stream_learning(spark: SparkSession, d: str) -> DataFrame:
    """Moments learnt over several micro-batches equal those of one batch."""
    rows, path, out = table(spark, d, "events"), _scratch(spark, "parts"), _scratch(spark, "learnt")
    rows.repartition(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    online.learn_stream(stream, "value", ("event_type",), _scratch(spark, "state"), lambda model, n: model.write.mode("overwrite").parquet(out), 1, _scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query("stream_scored", "SELECT event_id, round((value - 50) / sqrt(2000.0), 6) AS score FROM events")
def stream_scored(spark: SparkSession, d: str) -> DataFrame:
    doc = ir.load("<PMML version='4.1'><DataDictionary><DataField name='value' optype='continuous' dataType='double'/></DataDictionary><BaselineModel functionName='regression'><MiningSchema><MiningField name='value'/></MiningSchema><TestDistributions field='value' testStatistic='zValue'><Baseline><GaussianDistribution mean='50' variance='2000'/></Baseline></TestDistributions></BaselineModel></PMML>")
    out = _scratch(spark, "scored")
    online.score_stream(_stream(spark, d), doc, lambda batch, n: batch.write.mode("append").parquet(out), ("event_id",), _scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).withColumn("score", F.round("score", 6))


# --- files --------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


_PARTS = "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"


@query("src_csv", _PARTS)
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "parts") + ".csv"
    files.write(_parts(spark, d), path)
    return files.read_csv(spark, path)


@query("src_csv_typed_header", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def src_csv_typed_header(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "typed") + ".csv"
    named = _parts(spark, d).select(F.col("p_partkey").alias("p_partkey [integer]"), F.col("p_name").alias("p_name [string]"), F.col("p_size").alias("p_size [integer]"))
    named.write.option("header", True).option("sep", "\t").csv(path)
    return files.read_csv(spark, path, "\t")


@query("src_xml", _PARTS)
def src_xml(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "parts") + ".xml"
    files.write(_parts(spark, d), path)
    return files.read_xml(spark, path, "p_partkey bigint, p_name string, p_size bigint, p_retailprice double")


@query("src_fixed_width", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def src_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "fixed")
    _parts(spark, d).select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, " "), F.lpad(F.col("p_size").cast("string"), 6, " "), F.lpad(F.col("p_retailprice").cast("string"), 14, " ")).alias("value")).write.text(path)
    return files.read_fixed(spark, path, (("p_partkey", 10, "bigint"), ("p_size", 6, "bigint"), ("p_retailprice", 14, "double")))


@query("src_nab", "SELECT p_partkey, CAST(p_size AS INTEGER) AS p_size, p_retailprice FROM part")
def src_nab(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "packed")
    fields = (("p_partkey", "<i8"), ("p_size", "<i4"), ("p_retailprice", "<f8"))
    files.write_nab(_parts(spark, d), path, fields)
    return files.read_nab(spark, path, fields)


for _kind in ("xml", "json"):

    @query(f"src_scores_{_kind}", "SELECT event_id, event_type FROM events WHERE value > 60")
    def _scores(spark: SparkSession, d: str, _kind: str = _kind) -> DataFrame:
        path = _scratch(spark, "scores")
        files.write_scores(table(spark, d, "events").where("value > 60").select("event_id", "event_type"), path, _kind)
        return files.read_scores(spark, path, "event_id bigint, event_type string", _kind)


@query("src_malformed_rows", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 7 <> 2")
def src_malformed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as a file in which many rows have a cell of a wrong type or a cell too few; these are dropped."""
    path = _scratch(spark, "bad") + ".csv"
    size = F.when(F.col("p_partkey") % 10 == 3, F.lit("oops")).otherwise(F.col("p_size").cast("string"))
    cells = F.concat_ws(",", F.col("p_partkey").cast("string"), size, F.when(F.col("p_partkey") % 7 != 2, F.col("p_retailprice").cast("string")))
    _parts(spark, d).select(cells.alias("k [integer],size [integer],price [double]")).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_csv(spark, path, bad="drop")


@query("src_late_type", "SELECT p_partkey, CASE WHEN p_partkey % 1000 = 999 THEN p_size + 0.5 ELSE p_size END AS size, CASE WHEN p_partkey % 500 = 499 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS note FROM part")
def src_late_type(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose type shows only in late rows: no cell becomes null."""
    path = _scratch(spark, "late") + ".csv"
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    files.write(_parts(spark, d).orderBy("p_partkey").select("p_partkey", F.when(key % 1000 == 999, F.concat(size, F.lit(".5"))).otherwise(size).alias("size"), F.when(key % 500 == 499, "n/a").otherwise(size).alias("note")), path)
    return files.read_csv(spark, path)
