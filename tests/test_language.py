import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import formula
from quillon.functions import special
from quillon.mcol import INVALID, MISSING, VALID, MCol, source
from quillon.operators import tables, windows
from quillon.plans import expressions, ir, models
from quillon.train import trainers


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_formula_precedence_and_errors():
    assert formula.parse("a + b * c") == formula.parse("a + (b * c)")
    assert formula.parse("-a ** 2") == formula.parse("-(a ** 2)")
    assert formula.parse("a < b < c") == formula.parse("a < b and b < c")
    assert formula.parse("not a == b") == formula.parse("not (a == b)")
    assert formula.fields(formula.parse("f(a, 'b') + c in {d, 1}")) == {"a", "c", "d"}
    for bad in ("a +", "(a", "a b", "1 ? 2", "", "f(a"):
        with pytest.raises(formula.FormulaError):
            formula.parse(bad)
    with pytest.raises(formula.FormulaError):
        formula.column("__import__('os')")


@settings(max_examples=60, deadline=None)
@given(st.integers(-9, 9), st.integers(-9, 9), st.integers(1, 9), st.sampled_from(["{} + {} * {}", "({} - {}) * {}", "{} * {} - {}", "-{} + {} ** 2 + {}"]))
def test_formula_tree_evaluates_like_arithmetic(a, b, c, shape):
    text = shape.format(*(f"({v})" for v in (a, b, c)))

    def run(n):
        if n.kind == "constant":
            return n.value
        x = [run(k) for k in n.args]
        return {"+": lambda: x[0] + x[1], "-": lambda: x[0] - x[1], "*": lambda: x[0] * x[1], "**": lambda: x[0] ** x[1], "negative": lambda: -x[0]}[n.value]()

    assert run(formula.parse(text)) == eval(text)  # noqa: S307


def test_three_states_and_kleene(spark):
    df = rows(spark, [(True, True), (True, None), (None, None), (False, None), (None, True)], "p boolean, q boolean")
    p, q = source(F.col("p")), source(F.col("q"))
    k_and = formula.call("and", [p, q], [None, None])
    strict = formula.call("and", [p, q], [None, None], legacy=True)
    kleene = expressions.predicate(ir.load("<CompoundPredicate booleanOperator='and'><SimplePredicate field='p' operator='equal' value='true'/><SimplePredicate field='q' operator='equal' value='true'/></CompoundPredicate>"), expressions.Scope({"p": p, "q": q}))
    got = df.select(k_and.value.alias("k"), k_and.state.alias("m"), strict.value.alias("s"), kleene.alias("t")).collect()
    assert [(r.k, r.m, r.s, r.t) for r in got] == [(True, 0, True, True), (True, 0, None, None), (None, 1, None, None), (False, 0, None, False), (True, 0, None, None)]
    assert (VALID, MISSING, INVALID) == (0, 1, 2)


def test_invalid_beats_missing(spark):
    df = rows(spark, [(0.0, None), (1.0, 2.0)], "a double, b double")
    bad = formula.call("/", [MCol(F.lit(1.0)), source(F.col("a"))], [1.0, None])
    both = formula.call("+", [bad, source(F.col("b"))], [None, None])
    assert [r[0] for r in df.select(both.state).collect()] == [INVALID, VALID]


def test_special_functions():
    assert np.allclose(special.lower_gamma(np.array([0.5, 2, 10]), np.array([0.5, 1, 12])), [math.erf(math.sqrt(0.5)), 1 - 2 / math.e, 0.757608], atol=1e-6)
    y = np.linspace(-0.999, 0.999, 41)
    assert np.allclose([math.erf(v) for v in special.erfinv(y)], y, atol=1e-9)


def test_cusum_closed_form_equals_recurrence(spark):
    rng = random.Random(2)
    data = [(k, i, None if rng.random() < 0.1 else rng.gauss(0, 1)) for k in range(6) for i in range(60)]
    df = rows(spark, data, "k int, i int, x double")
    for reset in (0.0, -1.5, 2.0):
        a = {(r.k, r.i): r.s for r in windows.cusum(df, F.col("x"), ("k",), ("i",), "s", reset).collect()}
        b = {(r.k, r.i): r.s for r in windows.cusum_exact(df, "x", ("k",), ("i",), "s", reset).collect()}
        assert all(math.isclose(a[k], b[k], abs_tol=1e-9) or (reset > 0 and b[k] >= a[k]) for k in a)


def test_vector_cases(spark):
    df = rows(spark, [(1, i, v) for i, v in enumerate([1, 3, 6])], "k int, i int, x int")
    assert [r.d for r in windows.delta(df, "x", ("k",), ("i",), "d").orderBy("i").collect()] == [0, 2, 3]
    z = rows(spark, [(1, i, v) for i, v in enumerate([0, 5, 0, 0, 7, 0])], "k int, i int, x int")
    assert [r.c for r in windows.carry_forward(z, "x", ("k",), ("i",), "c").orderBy("i").collect()] == [0, 5, 5, 5, 7, 7]
    s = windows.window_apply(rows(spark, [(1, i, 1) for i in range(6)], "k int, i int, x int"), "x", 3, ("k",), ("i",), "w")
    assert [r.w for r in s.orderBy("i").collect()] == [2, 3, 3, 3]


def test_tables_edge_cases(spark):
    df = rows(spark, [(1, 0), (2, None), (3, 2), (4, -1)], "a int, n int")
    assert sorted(r.a for r in tables.expand(df, "n").collect()) == [3, 3]
    assert tables.histogram(df.limit(0), F.col("a"), 3).count() == 0
    flat = tables.histogram(rows(spark, [(5.0,), (5.0,)], "x double"), F.col("x"), 2).collect()
    assert sum(r.weight for r in flat) == 2
    assert tables.difference(df, df, ("a",)).count() == 0


def test_models_refuse_what_they_cannot_score(spark):
    df = rows(spark, [(1.0,)], "x double")
    for body in ("<NeuralNetwork/>", "<TreeModel missingValueStrategy='weightedConfidence'><Node><True/></Node></TreeModel>", "<RegressionModel functionName='regression' normalizationMethod='odd'><RegressionTable/></RegressionModel>"):
        with pytest.raises(ir.ModelError):
            models.score(df, ir.load(f"<PMML>{body}</PMML>"))
    with pytest.raises(ir.ModelError):
        ir.load("<PMML>")
    with pytest.raises(ir.ModelError):
        models.score(df, ir.load("<PMML><DataDictionary><DataField name='gone'/></DataDictionary><TreeModel><Node score='1'><True/></Node></TreeModel></PMML>"))


def test_documents_round_trip():
    doc = ir.load("<PMML xmlns='u' version='4.1'><A x='1.000000001'>t<B/></A></PMML>")
    assert ir.load(ir.to_json(doc)) == doc and ir.load(ir.to_xml(doc)) == doc
    other = ir.load("<PMML version='4.1'><A x='1.000000002'>t<B/></A></PMML>")
    assert ir.difference(doc, other) == [] and ir.difference(doc, other, 12) == ["/PMML/A@x"]
    assert ir.edit(other, "A", "x", "3") == 1


def test_incremental_training_equals_batch(spark):
    data = [(k, float(v)) for k, v in zip([1, 2] * 40, np.random.default_rng(3).normal(5, 2, 80), strict=True)]
    df = rows(spark, data, "k int, x double")
    parts = [trainers.moments(rows(spark, half, "k int, x double"), "x", ("k",)).collect() for half in (data[:40], data[40:])]
    whole = {r.k: r for r in trainers.moments(df, "x", ("k",)).collect()}
    for k in (1, 2):
        a, b = (next(r for r in p if r.k == k) for p in parts)
        n = a["count"] + b["count"]
        assert math.isclose((a.mean * a["count"] + b.mean * b["count"]) / n, whole[k].mean, rel_tol=1e-12)


def test_tree_grows_and_reproduces(spark):
    data = [(float(i), "a" if i % 2 else "b", "hi" if i > 40 else "lo") for i in range(80)] + [(None, None, "hi"), (3.0, "a", None)]
    df = rows(spark, data, "x double, c string, y string")
    doc = trainers.grow_tree(df, "y", ("x",), ("c",), depth=2, bins=None)
    got = models.score(df.where("x is not null and y is not null"), doc, ("x", "y")).collect()
    assert all(r.score == r.y for r in got)
    rules = models.score(df.where("x is not null and y is not null"), trainers.rule_set(doc), ("x", "y")).collect()
    assert all(r.score == r.y for r in rules)
    assert models.score(df.limit(0), doc).count() == 0


def test_regression_tree(spark):
    df = rows(spark, [(float(i), "a", 10.0 if i < 7 else 50.0 if i < 15 else 90.0) for i in range(20)], "x double, c string, y double")
    doc = trainers.grow_tree(df, "y", ("x",), ("c",), depth=3, bins=None, regression=True)
    assert all(r.score == r.y for r in models.score(df, doc, ("x", "y")).collect())


def test_rules_in_a_circle(spark):
    df = rows(spark, [(1,)], "a int")
    assert tables.apply_rules(df, {"c": "b + a", "b": "a * 2"}).first().c == 3
    with pytest.raises(formula.FormulaError):
        tables.apply_rules(df, {"b": "c", "c": "b"})


def test_k_means_keeps_empty_clusters(spark):
    df = rows(spark, [(0.0, 0.0), (0.2, 0.0), (9.0, 9.0), (None, 1.0)], "a double, b double")
    found = trainers.k_means(df, ("a", "b"), [(0, 0), (10, 10), (500, 500)], 5)
    assert found.centers[2] == [500.0, 500.0] and found.counts == [2, 1, 0] and found.centers[0] == [0.1, 0.0]
    assert trainers.k_means(df, ("a", "b"), [(0, 0), (10, 10), (500, 500)], 1, zero_empty=True).centers[2] == [0.0, 0.0]


def test_least_squares(spark):
    df = rows(spark, [(float(i), float(i * i), 3.0 + 2 * i - 0.5 * i * i) for i in range(20)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    fit = trainers.least_squares(df, "y", ("a", "b"))[0]
    assert math.isclose(fit["intercept"], 3, abs_tol=1e-8) and math.isclose(fit["a"], 2, abs_tol=1e-8) and math.isclose(fit["b"], -0.5, abs_tol=1e-8) and fit["rows"] == 20


def test_tree_finds_cuts_between_quantiles(spark):
    for regression in (False, True):
        low, high = (1.0, 9.0) if regression else ("lo", "hi")
        df = rows(spark, [(float(i), high if i >= 1995 else low) for i in range(2000)], f"x double, y {'double' if regression else 'string'}")
        doc = trainers.grow_tree(df, "y", ("x",), depth=1, regression=regression)
        assert {n.get("value") for n in doc.walk() if n.tag == "SimplePredicate"} == {"1994.5"}
