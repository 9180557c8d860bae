"""Queries of transformations, predicates and model scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import expressions, ir, models
from quillon.queries_functions import _CTE, frame
from quillon.registry import query
from quillon.session import table

_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_KEY = ", ".join(_LINE_KEY)
_LINE_FIELDS = "".join(f"<DataField name='{n}' optype='{o}' dataType='{t}'/>" for n, o, t in (("l_quantity", "continuous", "double"), ("l_extendedprice", "continuous", "double"), ("l_discount", "continuous", "double"), ("l_tax", "continuous", "double"), ("l_returnflag", "categorical", "string"), ("l_linestatus", "categorical", "string")))
_EVENT_FIELDS = "".join(f"<DataField name='{n}' optype='{o}' dataType='{t}'/>" for n, o, t in (("x", "continuous", "double"), ("y", "continuous", "double"), ("u", "continuous", "double"), ("i", "continuous", "integer"), ("j", "continuous", "integer"), ("k", "continuous", "integer"), ("s", "categorical", "string"), ("w", "categorical", "string")))


def document(body: str, fields: str = _LINE_FIELDS, transforms: str = "") -> ir.Node:
    return ir.load(f"<PMML version='4.1' xmlns='http://www.dmg.org/PMML-4_1'><DataDictionary>{fields}</DataDictionary>{f'<TransformationDictionary>{transforms}</TransformationDictionary>' if transforms else ''}{body}</PMML>")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


# --- transformations -------------------------------------------------------------------------------------


def _transform(name: str, transforms: str, sql: str, out: str = "r", kind: str = "num", mask_sql: str | None = None, last: bool = False, fields: str = _EVENT_FIELDS) -> None:
    shown = f"round(CAST({sql} AS DOUBLE), 6)" if kind == "num" else sql
    mask = f", CAST({mask_sql} AS INTEGER) AS m" if mask_sql else ""

    @query(name, f"{_CTE} SELECT event_id, {shown} AS r{mask} FROM e")
    def run(spark: SparkSession, d: str) -> DataFrame:
        doc = document("", fields, transforms)
        made = models.transform(frame(spark, d), doc, (out,), ("event_id",), masks=True, last_match=last)
        r = F.round(F.col(out).cast("double"), 6) if kind == "num" else F.col(out)
        return made.select("event_id", r.alias("r"), *([F.col(f"{out}__mask").alias("m")] if mask_sql else []))


_transform("xf_constant", "<DerivedField name='r' dataType='double' optype='continuous'><Constant dataType='double'>2.5</Constant></DerivedField>", "2.5")
_transform("xf_field_ref", "<DerivedField name='r' dataType='double' optype='continuous'><FieldRef field='x' mapMissingTo='-1'/></DerivedField>", "coalesce(x, -1)", mask_sql="0")
_transform("xf_derived_chain", "<DerivedField name='a'><Apply function='+'><FieldRef field='x'/><FieldRef field='y'/></Apply></DerivedField><DerivedField name='r'><Apply function='*'><FieldRef field='a'/><Constant dataType='double'>2</Constant></Apply></DerivedField>", "(x + y) * 2")
for _o, _sql in {
    "asIs": "CASE WHEN x < 0 THEN (x + 20) / 20 WHEN x < 30 THEN 1 + x / 15 ELSE 3 + (x - 30) / 70 END",
    "asExtremeValues": "CASE WHEN x < -20 THEN 0 WHEN x > 100 THEN 4 WHEN x < 0 THEN (x + 20) / 20 WHEN x < 30 THEN 1 + x / 15 ELSE 3 + (x - 30) / 70 END",
    "asMissingValues": "CASE WHEN x < -20 OR x > 100 THEN NULL WHEN x < 0 THEN (x + 20) / 20 WHEN x < 30 THEN 1 + x / 15 ELSE 3 + (x - 30) / 70 END",
}.items():
    _transform(f"xf_norm_continuous_{_o.lower()}", f"<DerivedField name='r'><NormContinuous field='x' outliers='{_o}'><LinearNorm orig='-20' norm='0'/><LinearNorm orig='0' norm='1'/><LinearNorm orig='30' norm='3'/><LinearNorm orig='100' norm='4'/></NormContinuous></DerivedField>", _sql)
_transform("xf_norm_discrete", "<DerivedField name='r'><NormDiscrete field='s' value='  click ' mapMissingTo='0.5'/></DerivedField>", "CASE WHEN s IS NULL THEN 0.5 WHEN s = '  click ' THEN 1 ELSE 0 END")
_BINS = "<DiscretizeBin binValue='low'><Interval closure='openOpen' rightMargin='0'/></DiscretizeBin><DiscretizeBin binValue='mid'><Interval closure='closedClosed' leftMargin='0' rightMargin='50'/></DiscretizeBin><DiscretizeBin binValue='high'><Interval closure='openClosed' leftMargin='40' rightMargin='200'/></DiscretizeBin>"
_transform("xf_discretize", f"<DerivedField name='r'><Discretize field='x' defaultValue='far' mapMissingTo='gone'>{_BINS}</Discretize></DerivedField>", "CASE WHEN x IS NULL THEN 'gone' WHEN x < 0 THEN 'low' WHEN x <= 50 THEN 'mid' WHEN x > 40 AND x <= 200 THEN 'high' ELSE 'far' END", kind="str")
_transform("xf_discretize_last", f"<DerivedField name='r'><Discretize field='x'>{_BINS}</Discretize></DerivedField>", "CASE WHEN x > 40 AND x <= 200 THEN 'high' WHEN x BETWEEN 0 AND 50 THEN 'mid' WHEN x < 0 THEN 'low' END", kind="str", mask_sql="CASE WHEN x IS NULL THEN 1 WHEN x > 200 THEN 2 ELSE 0 END", last=True)
_transform("xf_map_values", "<DerivedField name='r'><MapValues outputColumn='o' defaultValue='other' mapMissingTo='gone'><FieldColumnPair field='w' column='a'/><FieldColumnPair field='j' column='b'/><InlineTable><row><a>click</a><b>1</b><o>c1</o></row><row><a>view</a><b>-1</b><o>v-1</o></row><row><a>click</a><b>1</b><o>late</o></row></InlineTable></MapValues></DerivedField>", "CASE WHEN j IS NULL THEN 'gone' WHEN w = 'click' AND j = 1 THEN 'c1' WHEN w = 'view' AND j = -1 THEN 'v-1' ELSE 'other' END", kind="str")
_transform("xf_define_function", "<DefineFunction name='spread' optype='continuous'><ParameterField name='a'/><ParameterField name='b'/><Apply function='-'><Apply function='max'><FieldRef field='a'/><FieldRef field='b'/></Apply><Apply function='min'><FieldRef field='a'/><FieldRef field='b'/></Apply></Apply></DefineFunction><DerivedField name='r'><Apply function='spread'><FieldRef field='x'/><FieldRef field='y'/></Apply></DerivedField>", "CASE WHEN x IS NULL AND y IS NULL THEN NULL ELSE greatest(x, y) - least(x, y) END")
_transform("xf_formula", "<DerivedField name='r'><Formula>if(x between -10 and 30 and k in {1,2,3}, x ** 2 + k, -y)</Formula></DerivedField>", "CASE WHEN k IN (1, 2, 3) AND x IS NULL THEN pow(x, 2) + k WHEN coalesce(x BETWEEN -10 AND 30, TRUE) AND k IN (1, 2, 3) THEN pow(x, 2) + k ELSE -y END")
_transform("xf_cast_expression", "<DerivedField name='r'><CastExpression dataType='double' optype='continuous'><Interval closure='closedOpen' leftMargin='0' rightMargin='60'/><FieldRef field='x'/></CastExpression></DerivedField>", "CASE WHEN x >= 0 AND x < 60 THEN x END", mask_sql="CASE WHEN x IS NULL THEN 1 WHEN x >= 0 AND x < 60 THEN 0 ELSE 2 END")
_transform("xf_apply_missing", "<DerivedField name='r'><Apply function='ln' invalidValueTreatment='asMissing' mapMissingTo='-9'><FieldRef field='x'/></Apply></DerivedField>", "CASE WHEN x > 0 THEN ln(x) ELSE -9 END", mask_sql="0")
_transform("xf_regex_replace", "<DerivedField name='r'><X-EXT-RegularExpression field='w' pattern='(..)(.)' replacement='\\2-\\1'/></DerivedField>", "concat(substr(w, 3, 1), '-', substr(w, 1, 2))", kind="str")
_transform("xf_count_substrings", "<DerivedField name='r'><X-EXT-CountSubstrings field='w'><X-EXT-Substring value='c' weight='2'/><X-EXT-Substring value='i' weight='0.5'/></X-EXT-CountSubstrings></DerivedField>", "2 * (length(w) - length(replace(w, 'c', ''))) + 0.5 * (length(w) - length(replace(w, 'i', '')))")
_transform("xf_declared_values", "<DerivedField name='r'><FieldRef field='w'/></DerivedField>", "CASE WHEN w = 'click' THEN w END", kind="str", mask_sql="CASE WHEN w = 'view' THEN 1 WHEN w = 'click' THEN 0 ELSE 2 END", fields=_EVENT_FIELDS.replace("<DataField name='w' optype='categorical' dataType='string'/>", "<DataField name='w' optype='categorical' dataType='string'><Value value='click'/><Value value='view' property='missing'/></DataField>"))
_transform("xf_interval_validity", "<DerivedField name='r'><FieldRef field='x'/></DerivedField>", "CASE WHEN x > -10 AND x <= 40 THEN x END", mask_sql="CASE WHEN x IS NULL THEN 1 WHEN x > -10 AND x <= 40 THEN 0 ELSE 2 END", fields=_EVENT_FIELDS.replace("<DataField name='x' optype='continuous' dataType='double'/>", "<DataField name='x' optype='continuous' dataType='double'><Interval closure='openClosed' leftMargin='-10' rightMargin='40'/></DataField>"))


_transform("xf_cyclic", "<DerivedField name='r' dataType='integer' optype='ordinal' isCyclic='1'><Interval closure='closedClosed' leftMargin='1' rightMargin='7'/><Formula>i * 3 + k</Formula></DerivedField>", "((i * 3 + k - 1) % 7 + 7) % 7 + 1")
_transform("xf_days_since", "<DerivedField name='r' dataType='dateDaysSince[1980]' optype='continuous'><FieldRef field='t'/></DerivedField>", "date_diff('day', DATE '1980-01-01', t::DATE)")
_transform("xf_seconds_since", "<DerivedField name='r' dataType='dateTimeSecondsSince[1970]' optype='continuous'><FieldRef field='t'/></DerivedField>", "floor(epoch_us(t) / 1000000.0)")


@query("xf_fan_out", "SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS is_click FROM events")
def xf_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return expressions.fan_out_by_value(table(spark, d, "events"), "event_type", "is_").select("event_id", "is_click")


@query("join_map_values", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_map_values(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return expressions.map_values_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, {"c_nationkey": "n_nationkey"}, "n_name", "none").select("c_custkey", "n_name")


# --- mining fields -------------------------------------------------------------------------------------------

_ECHO = "<RegressionModel functionName='regression'><MiningSchema>{f}</MiningSchema><RegressionTable intercept='0'><NumericPredictor name='x' coefficient='1'/></RegressionTable></RegressionModel>"
for _n, _f, _sql, _m in (
    ("extreme", "<MiningField name='x' outliers='asExtremeValues' lowValue='-20' highValue='30'/>", "greatest(-20, least(30, x))", "CASE WHEN x IS NULL THEN 1 ELSE 0 END"),
    ("missing", "<MiningField name='x' outliers='asMissingValues' lowValue='-20' highValue='30'/>", "x", "CASE WHEN x IS NULL OR x < -20 OR x > 30 THEN 1 ELSE 0 END"),
    ("replace", "<MiningField name='x' outliers='asMissingValues' lowValue='-20' highValue='30' missingValueReplacement='7'/>", "CASE WHEN x IS NULL OR x < -20 OR x > 30 THEN 7 ELSE x END", "0"),
):

    @query(f"mining_field_{_n}", f"{_CTE} SELECT event_id, round(CASE WHEN {_m} = 0 THEN {_sql} END, 6) AS score, CAST({_m} AS INTEGER) AS score_mask FROM e".replace("least(30, x))", "least(30, x))") if _n != "extreme" else f"{_CTE} SELECT event_id, round(CASE WHEN x IS NOT NULL THEN {_sql} END, 6) AS score, CAST({_m} AS INTEGER) AS score_mask FROM e")
    def _mining_field(spark: SparkSession, d: str, _f: str = _f) -> DataFrame:
        out = models.score(frame(spark, d), document(_ECHO.format(f=_f), _EVENT_FIELDS), ("event_id",), masks=True)
        return out.withColumn("score", F.round("score", 6))


# --- predicates ------------------------------------------------------------------------------------------------


def _predicate(name: str, xml: str, sql: str) -> None:
    @query(f"pred_{name}", f"{_CTE} SELECT event_id, CAST({sql} AS BOOLEAN) AS r FROM e")
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = frame(spark, d)
        scope = models.input_scope(df, document("", _EVENT_FIELDS))
        hit = expressions.predicate(ir.load(xml), scope)
        return scope.applied(df).select("event_id", hit.alias("r"))


for _op, _sql in {"equal": "j = 1", "notEqual": "j <> 1", "lessThan": "j < 1", "lessOrEqual": "j <= 1", "greaterThan": "j > 1", "greaterOrEqual": "j >= 1", "isMissing": "j IS NULL", "isNotMissing": "j IS NOT NULL"}.items():
    _predicate(f"simple_{_op.lower()}", f"<SimplePredicate field='j' operator='{_op}'" + ("/>" if "Missing" in _op else " value='1'/>"), _sql)
_X, _Y, _S = "<SimplePredicate field='x' operator='greaterThan' value='0'/>", "<SimplePredicate field='y' operator='lessThan' value='5'/>", "<SimpleSetPredicate field='w' booleanOperator='isIn'><Array n='2' type='string'>click \"view\"</Array></SimpleSetPredicate>"
_predicate("set_in", _S, "w IN ('click', 'view')")
_predicate("set_not_in", "<SimpleSetPredicate field='j' booleanOperator='isNotIn'><Array n='2' type='int'>1 2</Array></SimpleSetPredicate>", "j NOT IN (1, 2)")
for _op, _sql in {"and": "x > 0 AND y < 5", "or": "x > 0 OR y < 5", "xor": "(x > 0) <> (y < 5)", "surrogate": "coalesce(x > 0, y < 5)"}.items():
    _predicate(f"compound_{_op}", f"<CompoundPredicate booleanOperator='{_op}'>{_X}{_Y}</CompoundPredicate>", _sql)
_predicate("true_false", "<CompoundPredicate booleanOperator='or'><False/><True/></CompoundPredicate>", "TRUE")
_predicate("nested", f"<CompoundPredicate booleanOperator='and'>{_S}<CompoundPredicate booleanOperator='or'>{_X}{_Y}</CompoundPredicate></CompoundPredicate>", "w IN ('click', 'view') AND (x > 0 OR y < 5)")

# --- baseline -----------------------------------------------------------------------------------------------------

_REVENUE = "<LocalTransformations><DerivedField name='net' optype='continuous' dataType='double'><Apply function='*'><FieldRef field='l_extendedprice'/><Apply function='-'><Constant dataType='double'>1</Constant><FieldRef field='l_discount'/></Apply></Apply></DerivedField></LocalTransformations>"
_LINE_SCHEMA = "<MiningSchema><MiningField name='l_quantity'/><MiningField name='l_extendedprice'/><MiningField name='l_discount'/><MiningField name='l_tax'/><MiningField name='l_returnflag'/><MiningField name='l_linestatus'/></MiningSchema>"


def z_model(field: str, mean: float, variance: float, extra: str = "") -> str:
    return f"<BaselineModel functionName='regression'>{_LINE_SCHEMA}{extra}<TestDistributions field='{field}' testStatistic='zValue'><Baseline><GaussianDistribution mean='{mean}' variance='{variance}'/></Baseline></TestDistributions></BaselineModel>"


def segmented(method: str, parts: list[tuple[str, str, str]]) -> str:
    body = "".join(f"<Segment id='{i}'>{p}{m}</Segment>" for i, p, m in parts)
    return f"<MiningModel functionName='regression'>{_LINE_SCHEMA}{_REVENUE}<Segmentation multipleModelMethod='{method}'>{body}</Segmentation></MiningModel>"


def _flag(v: str) -> str:
    return f"<SimplePredicate field='l_returnflag' operator='equal' value='{v}'/>"


_FLAGSHIP = segmented("selectFirst", [("A", _flag("A"), z_model("net", 36000, 5e8)), ("N", _flag("N"), z_model("net", 35000, 6e8)), ("R", _flag("R"), z_model("net", 37000, 4.1e8))])
_FLAG_SQL = "CASE l_returnflag WHEN 'A' THEN (l_extendedprice * (1 - l_discount) - 36000) / sqrt(5e8) WHEN 'N' THEN (l_extendedprice * (1 - l_discount) - 35000) / sqrt(6e8) WHEN 'R' THEN (l_extendedprice * (1 - l_discount) - 37000) / sqrt(4.1e8) END"


@query("model_segmented_zvalue", f"SELECT {_KEY}, l_returnflag AS segment, round({_FLAG_SQL}, 6) AS score, abs({_FLAG_SQL}) > 1.5 AS alert FROM lineitem")
def model_segmented_zvalue(spark: SparkSession, d: str) -> DataFrame:
    out = models.score(_lines(spark, d), document(_FLAGSHIP), _LINE_KEY, ("segment",))
    return out.select(*_LINE_KEY, "segment", F.round("score", 6).alias("score"), (F.abs("score") > 1.5).alias("alert"))


@query("model_zvalue", f"SELECT {_KEY}, round((l_quantity - 25.5) / sqrt(208.25), 6) AS score FROM lineitem")
def model_zvalue(spark: SparkSession, d: str) -> DataFrame:
    return models.score(_lines(spark, d), document(z_model("l_quantity", 25.5, 208.25)), _LINE_KEY).withColumn("score", F.round("score", 6))


@query("model_zvalue_pvalue")
def model_zvalue_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return models.score(_lines(spark, d), document(z_model("l_quantity", 25.5, 208.25)), _LINE_KEY, ("pValue",))


_CUSUM_DOC = f"<BaselineModel functionName='regression'>{_LINE_SCHEMA.replace('l_quantity', 'x')}<TestDistributions field='x' testStatistic='CUSUM' resetValue='0'><Baseline><GaussianDistribution mean='0' variance='900'/></Baseline><Alternate><GaussianDistribution mean='20' variance='900'/></Alternate></TestDistributions></BaselineModel>"


@query(
    "model_cusum",
    f"{_CTE}, u2 AS (SELECT e.event_id, e.x, v.user_id FROM e JOIN events v USING (event_id)), a AS (SELECT *, (20 * x - 200) / 900 AS v FROM u2), "
    "c AS (SELECT *, coalesce(sum(v) OVER w, 0) AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT event_id, round(s + coalesce(greatest(0, -min(CASE WHEN v IS NOT NULL THEN s END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 0), 6) AS score FROM c",
)
def model_cusum(spark: SparkSession, d: str) -> DataFrame:
    df = frame(spark, d).join(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    return models.score(df, document(_CUSUM_DOC, _EVENT_FIELDS), ("event_id",), order_by=("event_id",), partition_by=("user_id",)).withColumn("score", F.round("score", 6))


# --- trees ------------------------------------------------------------------------------------------------------------


def _tree_xml(strategy: str = "none", last: str = "returnNullPrediction") -> str:
    return (
        f"<TreeModel functionName='classification' missingValueStrategy='{strategy}' noTrueChildStrategy='{last}' missingValuePenalty='0.8'><MiningSchema><MiningField name='x'/><MiningField name='y'/><MiningField name='w'/></MiningSchema>"
        "<Node id='0' score='mid' defaultChild='1'><True/><ScoreDistribution value='low' recordCount='40'/><ScoreDistribution value='mid' recordCount='60'/>"
        "<Node id='1' score='low'><SimplePredicate field='x' operator='lessThan' value='0'/><ScoreDistribution value='low' recordCount='30'/><ScoreDistribution value='mid' recordCount='10'/>"
        "<Node id='2' score='low2'><SimplePredicate field='y' operator='lessThan' value='3'/></Node><Node id='3' score='low3'><SimplePredicate field='y' operator='greaterOrEqual' value='3'/></Node></Node>"
        "<Node id='4' score='high'><SimplePredicate field='x' operator='greaterThan' value='10'/><ScoreDistribution value='low' recordCount='5'/><ScoreDistribution value='high' recordCount='20'/></Node></Node></TreeModel>"
    )


_TREES = {
    "none": (("none", "returnNullPrediction"), "CASE WHEN coalesce(x < 0, FALSE) THEN CASE WHEN y < 3 THEN 'low2' WHEN y >= 3 THEN 'low3' END WHEN x > 10 THEN 'high' END"),
    "last_true": (("none", "returnLastPrediction"), "CASE WHEN coalesce(x < 0, FALSE) THEN CASE WHEN y < 3 THEN 'low2' WHEN y >= 3 THEN 'low3' ELSE 'low' END WHEN x > 10 THEN 'high' ELSE 'mid' END"),
    "last_prediction": (("lastPrediction", "returnNullPrediction"), "CASE WHEN x IS NULL THEN 'mid' WHEN x < 0 THEN CASE WHEN y IS NULL THEN 'low' WHEN y < 3 THEN 'low2' ELSE 'low3' END WHEN x > 10 THEN 'high' END"),
    "null_prediction": (("nullPrediction", "returnNullPrediction"), "CASE WHEN x IS NULL THEN NULL WHEN x < 0 THEN CASE WHEN y IS NULL THEN NULL WHEN y < 3 THEN 'low2' ELSE 'low3' END WHEN x > 10 THEN 'high' END"),
    "default_child": (("defaultChild", "returnLastPrediction"), "CASE WHEN x IS NULL OR x < 0 THEN CASE WHEN y < 3 THEN 'low2' WHEN y >= 3 THEN 'low3' END WHEN x > 10 THEN 'high' ELSE 'mid' END"),
}
for _n, (_args, _sql) in _TREES.items():

    @query(f"model_tree_{_n}", f"{_CTE} SELECT event_id, {_sql} AS score FROM e")
    def _tree(spark: SparkSession, d: str, _args: tuple = _args) -> DataFrame:
        return models.score(frame(spark, d), document(_tree_xml(*_args), _EVENT_FIELDS), ("event_id",))


@query("model_tree_features", f"{_CTE} SELECT event_id, CASE WHEN x < 0 THEN CASE WHEN y < 3 THEN '2' WHEN y >= 3 THEN '3' ELSE '1' END WHEN x > 10 THEN '4' ELSE '0' END AS entityId, CAST(CASE WHEN x < 0 THEN CASE WHEN y IS NULL THEN 0.75 END WHEN x > 10 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence FROM e")
def model_tree_features(spark: SparkSession, d: str) -> DataFrame:
    return models.score(frame(spark, d), document(_tree_xml("none", "returnLastPrediction"), _EVENT_FIELDS), ("event_id",), ("entityId", "confidence")).drop("score")


def deep_tree(depth: int) -> str:
    """A regression tree with a leaf for each unit interval of y."""

    def node(low: int, high: int, k: str, test: str) -> str:
        inner = "" if high - low == 1 else node(low, (low + high) // 2, k + "0", f"<SimplePredicate field='y' operator='lessThan' value='{(low + high) // 2}'/>") + node((low + high) // 2, high, k + "1", "<True/>")
        return f"<Node id='{k}' score='{low}'>{test}{inner}</Node>"

    return f"<TreeModel functionName='regression' noTrueChildStrategy='returnLastPrediction'><MiningSchema><MiningField name='y'/></MiningSchema>{node(0, 2**depth, 'n', '<True/>')}</TreeModel>"


@query("model_tree_deep", f"{_CTE} SELECT event_id, CAST(CASE WHEN y IS NULL THEN 127 ELSE least(127, floor(y)) END AS DOUBLE) AS score FROM e")
def model_tree_deep(spark: SparkSession, d: str) -> DataFrame:
    return models.score(frame(spark, d), document(deep_tree(7), _EVENT_FIELDS), ("event_id",))


# --- regression -------------------------------------------------------------------------------------------------------------

_TABLE = "<RegressionTable intercept='{i}'{c}><NumericPredictor name='l_quantity' coefficient='{a}' exponent='1'/><NumericPredictor name='l_discount' exponent='2' coefficient='{b}'/><CategoricalPredictor name='l_returnflag' value='R' coefficient='0.4'/><PredictorTerm coefficient='0.01'><FieldRef field='l_quantity'/><FieldRef field='l_tax'/></PredictorTerm></RegressionTable>"
_Y1 = "(0.5 + 0.02 * l_quantity + 3 * l_discount * l_discount + CASE WHEN l_returnflag = 'R' THEN 0.4 ELSE 0 END + 0.01 * l_quantity * l_tax)"
_Y2 = "(0.1 + 0.03 * l_quantity + -2 * l_discount * l_discount + CASE WHEN l_returnflag = 'R' THEN 0.4 ELSE 0 END + 0.01 * l_quantity * l_tax)"
for _n, _sql in {"none": _Y1, "softmax": f"1 / (1 + exp(-{_Y1}))", "exp": f"exp({_Y1})"}.items():

    @query(f"model_regression_{_n}", f"SELECT {_KEY}, round({_sql}, 6) AS score FROM lineitem")
    def _reg(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        doc = document(f"<RegressionModel functionName='regression' normalizationMethod='{_n}'>{_LINE_SCHEMA}{_TABLE.format(i=0.5, a=0.02, b=3, c='')}</RegressionModel>")
        return models.score(_lines(spark, d), doc, _LINE_KEY).withColumn("score", F.round("score", 6))


_P = {
    "softmax": (f"exp({_Y1}) / (exp({_Y1}) + exp({_Y2}))", f"exp({_Y2}) / (exp({_Y1}) + exp({_Y2}))"), "simplemax": (f"{_Y1} / ({_Y1} + {_Y2})", f"{_Y2} / ({_Y1} + {_Y2})"),
    "logit": (f"1 / (1 + exp(-{_Y1}))", f"1 - 1 / (1 + exp(-{_Y1}))"), "loglog": (f"exp(-exp(-{_Y1}))", f"1 - exp(-exp(-{_Y1}))"), "cloglog": (f"1 - exp(-exp({_Y1}))", f"1 - (1 - exp(-exp({_Y1})))"),
    "cauchit": (f"0.5 + atan({_Y1}) / pi()", f"0.5 - atan({_Y1}) / pi()"), "none": (_Y1, _Y2), "exp": (f"exp({_Y1})", f"exp({_Y2})"),
}
for _n, (_a, _b) in _P.items():

    @query(f"model_classification_{_n}", f"SELECT {_KEY}, CASE WHEN {_a} >= {_b} THEN 'p' ELSE 'q' END AS score, round({_a}, 6) AS probability_p FROM lineitem")
    def _cls(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        body = _TABLE.format(i=0.5, a=0.02, b=3, c=" targetCategory='p'") + _TABLE.format(i=0.1, a=0.03, b=-2, c=" targetCategory='q'")
        doc = document(f"<RegressionModel functionName='classification' normalizationMethod='{_n}'>{_LINE_SCHEMA}{body}</RegressionModel>")
        return models.score(_lines(spark, d), doc, _LINE_KEY, ("probability:p",)).withColumn("probability_p", F.round("probability_p", 6))


# --- naive Bayes, clusters, rules ------------------------------------------------------------------------------------------------


def _counts(pairs: dict[str, float]) -> str:
    return "<TargetValueCounts>" + "".join(f"<TargetValueCount value='{v}' count='{c}'/>" for v, c in pairs.items()) + "</TargetValueCounts>"


_NB = (
    "<NaiveBayesModel functionName='classification' threshold='0.001'>" + _LINE_SCHEMA + "<BayesInputs>"
    "<BayesInput fieldName='l_returnflag'>" + "".join(f"<PairCounts value='{v}'>{_counts(c)}</PairCounts>" for v, c in {"A": {"hi": 30, "lo": 10}, "N": {"hi": 50, "lo": 60}, "R": {"hi": 20}}.items()) + "</BayesInput>"
    "<BayesInput fieldName='l_linestatus'>" + "".join(f"<PairCounts value='{v}'>{_counts(c)}</PairCounts>" for v, c in {"O": {"hi": 70, "lo": 20}, "F": {"hi": 30, "lo": 50}}.items()) + "</BayesInput></BayesInputs>"
    f"<BayesOutput fieldName='t'>{_counts({'hi': 100, 'lo': 70})}</BayesOutput></NaiveBayesModel>"
)
_HI = "100 * CASE l_returnflag WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.5 WHEN 'R' THEN 0.2 ELSE 0.001 END * CASE l_linestatus WHEN 'O' THEN 0.7 WHEN 'F' THEN 0.3 ELSE 0.001 END"
_LO = "70 * CASE l_returnflag WHEN 'A' THEN 10 / 70 WHEN 'N' THEN 60 / 70 ELSE 0.001 END * CASE l_linestatus WHEN 'O' THEN 20 / 70 WHEN 'F' THEN 50 / 70 ELSE 0.001 END"


@query("model_naive_bayes", f"SELECT {_KEY}, CASE WHEN {_HI} >= {_LO} THEN 'hi' ELSE 'lo' END AS score, round(({_HI}) / (({_HI}) + ({_LO})), 6) AS probability_hi FROM lineitem")
def model_naive_bayes(spark: SparkSession, d: str) -> DataFrame:
    return models.score(_lines(spark, d), document(_NB), _LINE_KEY, ("probability:hi",)).withColumn("probability_hi", F.round("probability_hi", 6))


def cluster_model(metric: str, kind: str = "distance", fields: str = "", centers: tuple = ((10, 0.02), (25, 0.05), (40, 0.08)), names: tuple = ("l_quantity", "l_discount")) -> str:
    f = fields or "".join(f"<ClusteringField field='{n}' fieldWeight='{w}'/>" for n, w in zip(names, (1, 100), strict=True))
    c = "".join(f"<Cluster id='c{k}' name='n{k}'><Array n='2' type='real'>{a} {b}</Array></Cluster>" for k, (a, b) in enumerate(centers))
    return f"<ClusteringModel functionName='clustering' modelClass='centerBased' numberOfClusters='{len(centers)}'>{_LINE_SCHEMA}<ComparisonMeasure kind='{kind}'>{metric}</ComparisonMeasure>{f}{c}</ClusteringModel>"


def _argmin(parts: list[str], sign: str = "<=") -> str:
    a, b, c = parts
    return f"CASE WHEN {a} {sign} {b} AND {a} {sign} {c} THEN 'c0' WHEN {b} {sign} {c} THEN 'c1' ELSE 'c2' END"


_CENTERS = ((10, 0.02), (25, 0.05), (40, 0.08))
for _n, (_xml, _d) in {
    "euclidean": ("<euclidean/>", "sqrt(pow(abs(l_quantity - {a}), 2) + 100 * pow(abs(l_discount - {b}), 2))"), "squared_euclidean": ("<squaredEuclidean/>", "pow(abs(l_quantity - {a}), 2) + 100 * pow(abs(l_discount - {b}), 2)"),
    "city_block": ("<cityBlock/>", "abs(l_quantity - {a}) + 100 * abs(l_discount - {b})"), "chebychev": ("<chebychev/>", "greatest(abs(l_quantity - {a}), 100 * abs(l_discount - {b}))"),
    "minkowski": ("<minkowski p-parameter='3'/>", "pow(pow(abs(l_quantity - {a}), 3) + 100 * pow(abs(l_discount - {b}), 3), 1.0 / 3)"),
}.items():
    _parts = [_d.format(a=a, b=b) for a, b in _CENTERS]

    @query(f"model_cluster_{_n}", f"SELECT {_KEY}, round(least({', '.join(_parts)}), 6) AS affinity, {', '.join(f'round({p}, 6) AS all_c{k}' for k, p in enumerate(_parts))} FROM lineitem")
    def _cl(spark: SparkSession, d: str, _xml: str = _xml) -> DataFrame:
        out = models.score(_lines(spark, d), document(cluster_model(_xml)), _LINE_KEY, ("affinity", "all.c0", "all.c1", "all.c2"))
        return out.drop("score").withColumns({c: F.round(c, 6) for c in ("affinity", "all_c0", "all_c1", "all_c2")})


@query("model_cluster_label", f"SELECT {_KEY}, {_argmin([f'abs(l_quantity - {a})' for a, _ in _CENTERS])} AS score FROM lineitem")
def model_cluster_label(spark: SparkSession, d: str) -> DataFrame:
    fields = "<ClusteringField field='l_quantity' fieldWeight='1'/><ClusteringField field='l_discount' fieldWeight='0'/>"
    return models.score(_lines(spark, d), document(cluster_model("<cityBlock/>", fields=fields)), _LINE_KEY)


_BITS = "<DerivedField name='b1' dataType='double' optype='continuous'><Formula>if(x &gt; 0, 1.0, 0.0)</Formula></DerivedField><DerivedField name='b2' dataType='double' optype='continuous'><Formula>if(k &gt; 2, 1.0, 0.0)</Formula></DerivedField>"
_B1, _B2 = "CASE WHEN x > 0 THEN 1 ELSE 0 END", "CASE WHEN k > 2 THEN 1 ELSE 0 END"
for _n, (_xml, _f) in {
    "simple_matching": ("<simpleMatching/>", "(a11 + a00) / 2.0"), "jaccard": ("<jaccard/>", "a11 / nullif(a11 + a10 + a01, 0)"), "tanimoto": ("<tanimoto/>", "(a11 + a00) / (a11 + 2 * (a10 + a01) + a00)"),
    "binary_similarity": ("<binarySimilarity c00-parameter='0.5' c01-parameter='0' c10-parameter='0' c11-parameter='1' d00-parameter='1' d01-parameter='1' d10-parameter='2' d11-parameter='1'/>", "(a11 + 0.5 * a00) / (a11 + 2 * a10 + a01 + a00)"),
}.items():

    @query(
        f"model_cluster_{_n}",
        f"{_CTE}, b AS (SELECT event_id, {_B1} AS b1, {_B2} AS b2 FROM e WHERE x IS NOT NULL), n AS (SELECT event_id, (b1 = 1)::INT AS a11, (b2 = 1)::INT AS a10, (b1 = 0)::INT AS a01, (b2 = 0)::INT AS a00 FROM b) SELECT event_id, round({_f}, 6) AS all_c0 FROM n",
    )
    def _sim(spark: SparkSession, d: str, _xml: str = _xml) -> DataFrame:
        body = cluster_model(_xml, "similarity", "<ClusteringField field='b1'/><ClusteringField field='b2'/>", ((1, 0), (0, 1), (1, 1))).replace(_LINE_SCHEMA, f"<MiningSchema><MiningField name='x'/><MiningField name='k'/></MiningSchema><LocalTransformations>{_BITS}</LocalTransformations>")
        return models.score(frame(spark, d).where("x is not null"), document(body, _EVENT_FIELDS), ("event_id",), ("all.c0",)).select("event_id", F.round("all_c0", 6).alias("all_c0"))


@query("model_cluster_missing", f"{_CTE} SELECT event_id, round(CASE WHEN x IS NULL AND y IS NULL THEN NULL ELSE (coalesce(pow(x - 5, 2), 0) + coalesce(pow(y - 2, 2), 0)) * 2.0 / ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) END, 6) AS all_c0 FROM e")
def model_cluster_missing(spark: SparkSession, d: str) -> DataFrame:
    body = cluster_model("<squaredEuclidean/>", fields="<ClusteringField field='x'/><ClusteringField field='y'/>", centers=((5, 2), (0, 9), (50, 50))).replace(_LINE_SCHEMA, "<MiningSchema><MiningField name='x'/><MiningField name='y'/></MiningSchema>")
    return models.score(frame(spark, d), document(body, _EVENT_FIELDS), ("event_id",), ("all.c0",)).select("event_id", F.round("all_c0", 6).alias("all_c0"))


def _rules_xml(criterion: str) -> str:
    return (
        f"<RuleSetModel functionName='classification'>{_LINE_SCHEMA}<RuleSet defaultScore='none' defaultConfidence='0.1'><RuleSelectionMethod criterion='{criterion}'/>"
        "<SimpleRule id='r1' score='big' weight='0.6'><SimplePredicate field='l_quantity' operator='greaterThan' value='40'/></SimpleRule>"
        "<CompoundRule><SimplePredicate field='l_returnflag' operator='equal' value='R'/><SimpleRule id='r2' score='back' weight='0.7'><SimplePredicate field='l_discount' operator='greaterThan' value='0.05'/></SimpleRule></CompoundRule>"
        "<SimpleRule id='r3' score='big' weight='0.3'><SimplePredicate field='l_extendedprice' operator='greaterThan' value='60000'/></SimpleRule></RuleSet></RuleSetModel>"
    )


_R1, _R2, _R3 = "l_quantity > 40", "(l_returnflag = 'R' AND l_discount > 0.05)", "l_extendedprice > 60000"
_WBIG = f"(CASE WHEN {_R1} THEN 0.6 ELSE 0 END + CASE WHEN {_R3} THEN 0.3 ELSE 0 END)"
_WBACK = f"(CASE WHEN {_R2} THEN 0.7 ELSE 0 END)"
for _n, _sql in {
    "firstHit": f"CASE WHEN {_R1} THEN 'big' WHEN {_R2} THEN 'back' WHEN {_R3} THEN 'big' ELSE 'none' END",
    "weightedMax": f"CASE WHEN {_R2} THEN 'back' WHEN {_R1} THEN 'big' WHEN {_R3} THEN 'big' ELSE 'none' END",
    "weightedSum": f"CASE WHEN NOT ({_R1} OR {_R2} OR {_R3}) THEN 'none' WHEN {_WBIG} >= {_WBACK} THEN 'big' ELSE 'back' END",
}.items():

    @query(f"model_rules_{_n.lower()}", f"SELECT {_KEY}, {_sql} AS score FROM lineitem")
    def _rs(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        return models.score(_lines(spark, d), document(_rules_xml(_n)), _LINE_KEY)


# --- ensembles -----------------------------------------------------------------------------------------------------------------------


def _const(v: float) -> str:
    return f"<RegressionModel functionName='regression'>{_LINE_SCHEMA}<RegressionTable intercept='{v}'><NumericPredictor name='l_quantity' coefficient='{v}'/></RegressionTable></RegressionModel>"


_PARTS = [("s1", "<SimplePredicate field='l_quantity' operator='lessThan' value='30'/>", 1.0, 1.0), ("s2", "<SimplePredicate field='l_quantity' operator='greaterThan' value='20'/>", 2.0, 3.0), ("s3", _flag("R"), 4.0, 0.5)]
_C1, _C2, _C3 = "l_quantity < 30", "l_quantity > 20", "l_returnflag = 'R'"
_V = [f"CASE WHEN {c} THEN {v} + {v} * l_quantity END" for c, v in ((_C1, 1.0), (_C2, 2.0), (_C3, 4.0))]
_N = f"(({_C1})::INT + ({_C2})::INT + ({_C3})::INT)"
_SUM = "(" + " + ".join(f"coalesce({v}, 0)" for v in _V) + ")"
for _n, _sql in {
    "sum": f"CASE WHEN {_N} > 0 THEN {_SUM} END", "average": f"{_SUM} / nullif({_N}, 0)", "max": f"greatest({', '.join(_V)})", "median": f"list_median(list_filter([{', '.join(_V)}], lambda v: v IS NOT NULL))",
    "weightedAverage": "(" + " + ".join(f"coalesce({v}, 0) * {w}" for v, w in zip(_V, (1.0, 3.0, 0.5), strict=True)) + f") / nullif(({_C1})::INT * 1.0 + ({_C2})::INT * 3.0 + ({_C3})::INT * 0.5, 0)",
}.items():

    @query(f"model_mining_{_n.lower()}", f"SELECT {_KEY}, round({_sql}, 6) AS score, {_N} AS cardinality FROM lineitem")
    def _mm(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        body = "".join(f"<Segment id='{i}' weight='{w}'>{p}{_const(v)}</Segment>" for i, p, v, w in _PARTS)
        doc = document(f"<MiningModel functionName='regression'>{_LINE_SCHEMA}<Segmentation multipleModelMethod='{_n}'>{body}</Segmentation></MiningModel>")
        return models.score(_lines(spark, d), doc, _LINE_KEY, ("cardinality",)).withColumn("score", F.round("score", 6))


def _label(v: str) -> str:
    return f"<TreeModel functionName='classification'>{_LINE_SCHEMA}<Node id='1' score='{v}'><True/></Node></TreeModel>"


_VOTES = [("v1", "<True/>", "a", 1.0), ("v2", "<SimplePredicate field='l_quantity' operator='greaterThan' value='20'/>", "b", 1.0), ("v3", "<SimplePredicate field='l_discount' operator='greaterThan' value='0.05'/>", "b", 0.2)]
_VB, _WB = "((l_quantity > 20)::INT + (l_discount > 0.05)::INT)", "((l_quantity > 20)::INT * 1.0 + (l_discount > 0.05)::INT * 0.2)"
for _n, _sql in {"majorityVote": f"CASE WHEN {_VB} > 1 THEN 'b' ELSE 'a' END", "weightedMajorityVote": f"CASE WHEN {_WB} > 1 THEN 'b' ELSE 'a' END"}.items():

    @query(f"model_mining_{_n.lower()}", f"SELECT {_KEY}, {_sql} AS score FROM lineitem")
    def _mv(spark: SparkSession, d: str, _n: str = _n) -> DataFrame:
        body = "".join(f"<Segment id='{i}' weight='{w}'>{p}{_label(v)}</Segment>" for i, p, v, w in _VOTES)
        doc = document(f"<MiningModel functionName='classification'>{_LINE_SCHEMA}<Segmentation multipleModelMethod='{_n}'>{body}</Segmentation></MiningModel>")
        return models.score(_lines(spark, d), doc, _LINE_KEY)


@query("model_mining_selectall", f"SELECT {_KEY}, ({_C1})::INT + ({_C2})::INT AS n, CASE WHEN {_C1} THEN 's1' WHEN {_C2} THEN 's2' END AS first_segment FROM lineitem")
def model_mining_selectall(spark: SparkSession, d: str) -> DataFrame:
    body = "".join(f"<Segment id='{i}'>{p}{_const(v)}</Segment>" for i, p, v, _ in _PARTS[:2])
    doc = document(f"<MiningModel functionName='regression'>{_LINE_SCHEMA}<Segmentation multipleModelMethod='selectAll'>{body}</Segmentation></MiningModel>")
    out = models.score(_lines(spark, d), doc, _LINE_KEY, ("cardinality",))
    return out.select(*_LINE_KEY, F.col("cardinality").alias("n"), F.try_element_at("score", F.lit(1))["segment"].alias("first_segment"))


@query("model_output", f"SELECT {_KEY}, round((l_quantity - 25.5) / sqrt(208.25), 6) AS z, round(abs((l_quantity - 25.5) / sqrt(208.25)), 6) AS size, l_quantity AS qty FROM lineitem")
def model_output(spark: SparkSession, d: str) -> DataFrame:
    output = "<Output><OutputField name='z' feature='predictedValue' dataType='double' optype='continuous'/><OutputField name='size' feature='transformedValue'><Apply function='abs'><FieldRef field='z'/></Apply></OutputField><OutputField name='qty'><FieldRef field='l_quantity'/></OutputField></Output>"
    doc = document(z_model("l_quantity", 25.5, 208.25).replace("<TestDistributions", output + "<TestDistributions"))
    return models.score(_lines(spark, d), doc, _LINE_KEY).select(*_LINE_KEY, F.round("z", 6).alias("z"), F.round("size", 6).alias("size"), "qty")


@query("model_verification", "SELECT * FROM (VALUES (0, 'z', '1.5', '1.5', TRUE), (1, 'z', '-2', '-2.0', TRUE), (2, 'z', '0.3', '0.5', FALSE)) AS v(case_no, field, expected, found, agrees)")
def model_verification(spark: SparkSession, d: str) -> DataFrame:
    block = "<ModelVerification><VerificationFields><VerificationField field='v' column='v'/><VerificationField field='z' precision='1e-6'/></VerificationFields><InlineTable><row><v>13</v><z>1.5</z></row><row><v>6</v><z>-2</z></row><row><v>11</v><z>0.3</z></row></InlineTable></ModelVerification>"
    body = f"<BaselineModel functionName='regression'><MiningSchema><MiningField name='v'/></MiningSchema><Output><OutputField name='z' feature='predictedValue'/></Output><TestDistributions field='v' testStatistic='zValue'><Baseline><GaussianDistribution mean='10' variance='4'/></Baseline></TestDistributions>{block}</BaselineModel>"
    return models.verify(spark, document(body, "<DataField name='v' optype='continuous' dataType='double'/>"))


@query("model_split", f"SELECT {_KEY}, round({_FLAG_SQL}, 6) AS score FROM lineitem")
def model_split(spark: SparkSession, d: str) -> DataFrame:
    """A segmented model split in two; each half scores its share of the rows and the halves join in one projection."""
    halves = [models.score(_lines(spark, d), part, _LINE_KEY) for part in ir.split_segments(document(_FLAGSHIP), 2)]
    rest = [h.where(F.col("score").isNotNull()) for h in halves]
    return rest[0].unionByName(rest[1]).withColumn("score", F.round("score", 6))
