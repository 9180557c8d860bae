import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import cli, formula, hooks, queries_more
from quillon.operators import tables
from quillon.plans import ir, models
from quillon.sources import files
from quillon.streaming import online
from quillon.train import producers, trainers

FIELD = "<DataField name='x' optype='continuous' dataType='double'/>"
DECLARED = f"<DataDictionary>{FIELD}</DataDictionary>"


def test_probit_on_all_rows(spark):
    doc = queries_more._regressions("probit", "<MiningSchema><MiningField name='x'/></MiningSchema>", FIELD)
    xs = [(i, float(x)) for i, x in enumerate(np.linspace(-90, 90, 200))] + [(900, None)]
    got = {r.i: r for r in models.score(spark.createDataFrame(xs, "i long, x double"), doc, ("i",), ("probability:low",)).collect()}
    for i, x in xs[:-1]:
        assert got[i].probability_low == pytest.approx(NormalDist().cdf(-0.5 + 0.05 * x), abs=1e-7)
    assert got[900].probability_low is None


@pytest.mark.parametrize("name, cdf", [("<UniformDistribution lower='0' upper='10'/>", lambda x: min(1, max(0, x / 10))), ("<ExponentialDistribution mean='2'/>", lambda x: 1 - math.exp(-x / 2)), ("<PoissonDistribution mean='3'/>", lambda x: sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(int(x) + 1)))])
def test_z_values_by_way_of_the_cumulative(spark, name, cdf):
    text = f"<PMML version='4.1'>{DECLARED}<BaselineModel functionName='regression'><MiningSchema><MiningField name='x'/></MiningSchema><TestDistributions field='x' testStatistic='zValue'><Baseline>{name}</Baseline></TestDistributions></BaselineModel></PMML>"
    xs = [(i, x) for i, x in enumerate([0.5, 1.0, 2.5, 4.0, 6.0, 9.0])]
    got = {r.i: r.score for r in models.score(spark.createDataFrame(xs, "i long, x double"), ir.load(text), ("i",), legacy=True).collect()}
    for i, x in xs:
        assert got[i] == pytest.approx(NormalDist().inv_cdf(min(max(cdf(x), 1e-20), 1 - 1e-16)), abs=2e-3)


def rows(spark):
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 0.3, (100, 2)) for c in ((0, 0), (8, 8), (0, 8))])
    return spark.createDataFrame([(float(a), float(b), float(i % 5)) for i, (a, b) in enumerate(points)] + [(None, 1.0, 1.0)], "a double, b double, w double")


def test_starts_and_trials(spark):
    df = rows(spark)
    for method in ("data", "weighted", "covariance", "unitRect"):
        found = producers.starts(df, ("a", "b"), 3, 4, method, "w")
        assert len(found) == 3 and found == producers.starts(df, ("a", "b"), 3, 4, method, "w")
    best = producers.converged_trials(df, ("a", "b"), 3, trials=6, number=2)
    assert sorted(map(round, np.ravel(best.centers))) == [0, 0, 0, 8, 8, 8]
    assert trainers.k_means(df, ("a", "b"), producers.small_trials(df, ("a", "b"), 3)).mean_distance == pytest.approx(best.mean_distance, rel=0.01)
    assert producers.small_trials(df.where("a > 1e9"), ("a", "b"), 3) == [] and producers.starts(df.where("a > 1e9"), ("a", "b"), 3, 1, "covariance") == []


def test_covariance_against_numpy(spark):
    df = rows(spark).withColumn("a", F.col("a") + 1e6)
    data = np.array([list(r) for r in df.na.drop().collect()])
    for weight, w in ((None, None), ("w", data[:, 2])):
        kept = data if w is None else data[w > 0]
        got = {(r.a, r.b): r.covariance for r in producers.covariance(df, ("a", "b"), weight=weight).collect()}
        want = np.cov(kept[:, :2].T, bias=True, aweights=None if w is None else w[w > 0])
        assert [got["a", "a"], got["a", "b"], got["b", "b"]] == pytest.approx([want[0, 0], want[0, 1], want[1, 1]], rel=1e-6)
    assert producers.line_fit(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first().slope is None


def test_baselines(spark):
    df = spark.createDataFrame([("a", 1.0, "n"), ("a", 3.0, "n"), ("a", 9.0, "y"), ("b", 5.0, "n"), (None, 7.0, "n"), ("c", None, "n")], "s string, x double, f string")
    found = producers.distributions(producers.baseline(df, "x", segment="s", alternate=("f", "y")))
    assert [(s, p) for s, p, *_ in found] == [("a", "Baseline"), ("a", "Alternate"), ("b", "Baseline")]
    with pytest.raises(ValueError):
        producers.baseline(df, "x", segment="s", zero_variance="exception")
    with pytest.raises(ValueError):
        producers.baseline(df, "x", segment="s", most=1)
    assert producers.cells(producers.count_document(df, ("s", "f"))) == [(("a", "n"), 2.0), (("a", "y"), 1.0), (("b", "n"), 1.0), (("c", "n"), 1.0)]


def test_gini_of_pairs(spark):
    for a, b, want in (([1, 1, 1], [1, 1, 1], 0), ([1, 1, 1], [2, 2, 2], 0), ([1, 1, 1], [1, 1, 2], 2 / 9), ([1, 2, 3], [1, 2, 3, 4, 5], 0.75)):
        n = max(len(a), len(b))
        df = spark.createDataFrame([(i, a[i] if i < len(a) else None, b[i] if i < len(b) else None) for i in range(n)], "i int, a int, b int")
        assert tables.gini_joint(df, "a", "b").first()[0] == pytest.approx(want)


def test_table_verbs(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k long, t string, v double")
    assert tables.scan(df).splitlines()[1].split() == ["1", "a", "0.5"] and tables.scan(df).splitlines()[2].split() == ["2", ".", "."]
    assert [r.k for r in tables.resize(df, ("k",), 1).collect()] == [2] and [r.k for r in tables.head(df, ("k",), 1).collect()] == [1]
    with pytest.raises(ValueError):
        tables.fill(df, [{"nope": 1}])
    assert tables.fill(df, []).count() == 2
    got = {r.k: (r.t, r.z) for r in tables.update(df, spark.createDataFrame([(2, "new", 7)], "k long, t string, z int"), ("k",)).collect()}
    assert got == {1: ("a", None), 2: ("new", 7)}


def test_hooks_and_functions(spark):
    class Failing(hooks.Hooks):
        def event(self, rows):
            if (rows["x"] < 0).any():
                raise ValueError("negative")
            return rows

        def exception(self, error, rows):
            return rows[rows["x"] >= 0]

        def end(self):
            return pd.DataFrame({"x": [1000]})

    df = spark.createDataFrame([(1,), (-2,), (3,)], "x long").coalesce(1)
    assert sorted(r.x for r in hooks.process(df, Failing, "x long").collect()) == [1, 3, 1000]
    with pytest.raises(Exception, match="negative"):
        hooks.process(df, type("Strict", (Failing,), {"exception": hooks.Hooks.exception}), "x long").collect()
    hooks.register("half", lambda a: a / 2)
    try:
        with pytest.raises(ValueError):
            hooks.register("half", lambda a: a)
        doc = ir.load(f"<PMML version='4.1'>{DECLARED}<TransformationDictionary><DerivedField name='r'><Apply function='half'><FieldRef field='x'/></Apply></DerivedField></TransformationDictionary></PMML>")
        got = models.transform(spark.createDataFrame([(4.0,), (None,)], "x double"), doc, ("r",), masks=True).collect()
        assert [tuple(r) for r in got] == [(2.0, 0), (None, 1)]
        assert formula.compile_plain(formula.parse("half(x)")) is not None
    finally:
        hooks.unregister("half")
    slow = hooks.vectorised(lambda a, b: a + b)
    assert [r[0] for r in spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double").select(slow(F.col("a"), F.col("b"))).collect()] == [3.0, None]


def test_engine(spark):
    doc = queries_more.document(queries_more._BASE, FIELD)
    engine = hooks.Engine(spark, doc, "x double")
    assert engine.events([{"x": 30}, {"x": None}, {}]) == [{"score": 1.0}, {"score": None}, {"score": None}]
    assert engine.events([]) == [] and engine.event({"x": 10, "other": 1}) == {"score": 0.0}


def test_model_output_by_time(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", float(i))], "k string, x double").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    made = []
    stream = spark.readStream.schema("k string, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    online.learn_stream(stream, "x", ("k",), str(tmp_path / "s"), lambda m, n: made.append(n), 10**9, str(tmp_path / "c"), every_seconds=0.0).awaitTermination()
    assert made == [0, 1, 2]


def test_score_tools(spark, tmp_path, capsys):
    for name, v in (("a", 1.0), ("b", 1.5)):
        files.write_scores(spark.createDataFrame([(1, v), (2, 3.0)], "k long, score double"), str(tmp_path / name))
    a, b, schema = str(tmp_path / "a"), str(tmp_path / "b"), "k long, score double"
    assert cli.main(["diffscores", a, b, schema, "k"]) == 1 and cli.main(["diffscores", a, a, schema, "k"]) == 0
    assert cli.main(["scores", a, str(tmp_path / "o.parquet"), schema, "k=k;twice=score*2", "--where", "score > 2"]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o.parquet")).collect()] == [(2, 6.0)]
    assert cli.main(["select", str(tmp_path / "o.parquet"), str(tmp_path / "p.csv"), "k=k"]) == 0
    assert cli.main(["head", str(tmp_path / "p.csv"), "--order", "k"]) == 0 and "k" in capsys.readouterr().out
