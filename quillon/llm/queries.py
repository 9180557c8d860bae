"""Registered queries of the language-model operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import leakage, mixing, pii
from quillon.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=1)
    return near.filter("edits = 0").select("doc_id", "item_id")


_GRAMS = r"list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))"
_WORDS = r"""regexp_extract_all(lower(regexp_replace(replace({t}, '\\', ' '), '\\[A-Za-z]+', ' ', 'g')), '[\p{{L}}\p{{M}}\p{{N}}]+')"""
SQL["p6_found"] = (
    f"WITH d AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format(t='passage')} AS w FROM eval_items), "
    f"g AS (SELECT doc_id, unnest({_GRAMS}) AS s FROM d WHERE len(w) >= 13), h AS (SELECT item_id, unnest({_GRAMS}) AS s FROM i WHERE len(w) >= 13) SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (s)"
)


@query
def p6_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialise(mixing.token_counts(table(spark, d, "documents")), "sizes")
    return mixing.mixture(sizes, table(spark, d, "source_targets"))


@query
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).select("doc_id", "line_no", "pii_type").distinct()


@query
def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "masked_text")
