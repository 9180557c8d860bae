"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Documents are permuted within their source by a seeded hash and laid out in blocks of equal token length;
a source that must repeat is laid out anew, permuted anew, for each pass. The blocks of all sources are
dealt to output shards by a splitting tree: at each node a multivariate-hypergeometric draw splits the exact
block quotas between the two halves of the shards, so every shard holds a random share of every source and
the sums are exact. A shard takes disjoint runs of permuted blocks and shuffles them locally.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise, spread

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SENT: set[tuple[str, str]] = set()


def _sent(spark: SparkSession, path: str) -> None:
    """Sends a file to the executors, once a context."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add(key)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of whole texts; a null text has none.

    The tokenizer's file, a path of the driver or any URI Spark can fetch, is sent to the executors.
    """
    _sent(docs.sparkSession, tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name))
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return spread(docs.select(F.col(doc_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col))).mapInArrow(run, "doc_id long, source string, tokens long")


def plan_quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source.

    ``have``: tokens there are; ``targets``: share (any unit) and most uses. Without ``total``, the largest
    mixture in which every source that exists reaches its share. With it, sources that run out give what
    they can and the others share the rest by their targets, as far as their own caps go.
    """
    live = {s: t for s, t in targets.items() if have.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    cap = {s: have[s] * live[s][1] for s in live}
    weight = sum(t[0] for t in live.values())
    if not live:
        return {}
    if total is None:
        total = int(min(cap[s] * weight / live[s][0] for s in live))
        return {s: min(cap[s], int(total * live[s][0] / weight)) for s in live}
    quota: dict[str, int] = {}
    left, open_ = total, dict(live)
    while open_:
        weight = sum(t[0] for t in open_.values())
        full = [s for s in open_ if cap[s] <= left * open_[s][0] / weight]
        if not full:
            return quota | {s: int(left * t[0] / weight) for s, t in open_.items()}
        for s in full:
            quota[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return quota


def splitting_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts; columns sum to ``blocks``, shard sizes differ by rounding only."""
    out = np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        first, m, here = todo.pop()
        if m == 1:
            out[first] = here
            continue
        half = m // 2
        share = int(here.sum()) * half // m
        draw = np.random.default_rng([seed, first, m]).multivariate_hypergeometric(here, share, method="marginals")
        todo += [(first, half, draw), (first + half, m - half, here - draw)]
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None, block_tokens: int = 20_000, shard_tokens: int = 2_000_000, most_shards: int = 10_000, bucket_docs: int = 100_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) of a mixture.

    draws: doc_id, source, use (from 1), shard, place (in its shard), tokens. shares: source, target_pct,
    actual_pct, tokens, draws, documents, most_uses.

    Documents of a null source or one without a target, and those without tokens, are left out; a source
    without documents is reported with 0. A doc_id counts once. No document is used more than its source's
    max_repeats. A source's tokens are met to within one document from below. Null targets count as 0.
    Only per-source totals, of as many rows as there are targets, and the shard plan reach the driver: the
    shards grow once there would be more than ``most_shards``. Documents are ordered in buckets of about
    ``bucket_docs``, so a source with a third of all documents is ordered by many tasks.
    """
    spark = sizes.sparkSession
    goal = {r["source"]: (float(r["target_pct"] or 0), int(r["max_repeats"] or 0)) for r in targets.filter("source is not null").groupBy("source").agg(F.max("target_pct").alias("target_pct"), F.max("max_repeats").alias("max_repeats")).toLocalIterator()}
    wanted = F.col("source").isin(list(goal)) & (F.col("tokens") > 0)
    sizes = sizes.filter(wanted).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.*")
    known = [(r["source"], int(r["t"]), int(r["n"])) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).toLocalIterator()]
    have = {s: t for s, t, _ in known}
    buckets = max(1, -(-max((n for *_, n in known), default=0) // bucket_docs))
    quota = plan_quotas(have, goal, total)
    names = sorted(quota)
    n_blocks = np.array([-(-quota[s] // block_tokens) for s in names], np.int64)
    shards = min(most_shards, max(1, -(-sum(quota.values()) // shard_tokens)))
    dealt = splitting_tree(n_blocks, shards, seed) if names else np.zeros((1, 0), np.int64)
    ranges = []
    for k, s in enumerate(names):
        upto = np.cumsum(dealt[:, k])
        ranges += [(s, i, int(upto[i] - dealt[i, k]), int(upto[i])) for i in range(shards) if dealt[i, k]]
    # Ranges are met by groups of blocks, so that a block is compared with the few ranges near it only.
    group = max(1, int(np.median([b - a for *_, a, b in ranges])) if ranges else 1)
    dealt_to = spark.createDataFrame(ranges, "source string, shard int, from_block long, to_block long")
    dealt_to = dealt_to.withColumn("near", F.explode(F.sequence(F.floor(F.col("from_block") / group), F.floor((F.col("to_block") - 1) / group))))
    # A bijection of each source's blocks: place -> place * stride + 1 modulo their number.
    stride = [next(a for a in range(max(1, int(n * 0.618)), int(n) + 2) if np.gcd(a, int(n)) == 1) for n in n_blocks]
    facts = spark.createDataFrame([(s, have[s], quota[s], int(n), int(a)) for s, n, a in zip(names, n_blocks, stride, strict=True)], "source string, have long, quota long, n_blocks long, stride long")

    uses = sizes.join(F.broadcast(facts), "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("have")).cast("int"))))
    uses = uses.withColumn("rank", F.xxhash64(F.lit(seed), "doc_id", "use")).withColumn("bucket", F.floor((F.shiftrightunsigned("rank", 33) * F.lit(buckets)) / F.lit(1 << 31)).cast("int"))
    part = W.partitionBy("source", "use", "bucket").orderBy("rank", "doc_id")
    sums = uses.groupBy("source", "use", "bucket").agg(F.sum("tokens").alias("bt"))
    before = W.partitionBy("source", "use").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "use", "bucket", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("base"))
    laid = uses.join(sums, ["source", "use", "bucket"]).withColumn("at", (F.col("use") - 1) * F.col("have") + F.col("base") + F.sum("tokens").over(part.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
    laid = laid.filter(F.col("at") + F.col("tokens") <= F.col("quota"))
    laid = laid.withColumn("block", F.pmod(F.floor(F.col("at") / block_tokens) * F.col("stride") + 1, F.col("n_blocks")))
    laid = laid.withColumn("near", F.floor(F.col("block") / group))
    placed = laid.join(F.broadcast(dealt_to) if len(ranges) <= 100_000 else dealt_to, ["source", "near"]).filter((F.col("block") >= F.col("from_block")) & (F.col("block") < F.col("to_block")))
    local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "use"), "doc_id", "use")
    draws = placed.select("doc_id", "source", "use", "shard", F.row_number().over(local).alias("place"), "tokens")
    draws = materialise(draws, "mixture")
    by = draws.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("draws"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_uses"))
    listed = spark.createDataFrame([(s, g[0]) for s, g in sorted(goal.items())], "source string, target_pct double")
    shares = listed.join(by, "source", "left").na.fill(0)
    whole = F.sum("tokens").over(W.partitionBy())
    shares = shares.select("source", "target_pct", F.coalesce(F.try_divide(F.col("tokens") * 100.0, whole), F.lit(0.0)).alias("actual_pct"), "tokens", "draws", "documents", "most_uses")
    return draws, shares


