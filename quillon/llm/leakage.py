"""Evaluation passages leaking into training text.

Item-sized windows of words go through a CGK random walk, which maps a small edit distance to a small
Hamming distance; repeated samples of the walk's positions are the LSH keys. Passages are cut into windows
of ``window`` words; texts into windows of that length and of up to ``edits`` words less or more, so that
inserted and deleted words are met like replaced ones. Windows that share a key with a window of a passage
are verified by their exact word edit distance.

Three bitmaps cut the work without losing a pair: one of the passages' words (a window within e edits of a
passage window has at most e foreign words), one of their runs of words (e edits leave e + 1 runs at most, so one
run of a share of the words is untouched) and one of their LSH keys. Their size follows from the counted index, up
to 16 MB each. They may let too much through, never too little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import Words, chunks, mix
from quillon.session import materialise, spread

#: Bits of the bitmaps' addresses at least and at most.
LEAST_BITS, MOST_BITS = 16, 27


class WalkHash:
    """CGK walk of ``window`` symbols to 3 × ``window`` ones, then ``repeats`` keys of ``samples`` positions each.

    ``repeats`` follows from the target recall at ``edits`` edits: an edit leaves the two walks apart for
    about ``drift`` positions (measured; insertions drift farthest), so a key survives with probability (1 - edits × drift / length) ** samples.
    At 0 edits equal windows share every key, and one repetition reaches any recall.
    """

    def __init__(self, window: int, edits: int, recall: float = 0.95, samples: int = 6, drift: float = 5.5, seed: int = 7) -> None:
        self.window, self.length, self.samples = window, 3 * window, samples
        alive = max(0.05, 1 - edits * drift / self.length) ** samples
        self.repeats = 1 if edits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 63, (self.repeats, self.length), dtype=np.uint64)
        self.places = [np.sort(rng.choice(self.length, samples, replace=False)) for _ in range(self.repeats)]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(n, words) word hashes to (n, repeats) keys; all windows of a call have the same number of words."""
        n, words = windows.shape
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        out, rows = np.zeros((n, self.repeats), np.uint64), np.arange(n)
        for r in range(self.repeats):
            at, key = np.zeros(n, np.int64), np.full(n, np.uint64(r + 1))
            wanted = set(self.places[r].tolist())
            for j in range(self.places[r][-1] + 1):
                symbol = padded[rows, at]
                if j in wanted:
                    key = mix(key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                step = mix(symbol ^ self.seeds[r, j]) & np.uint64(1)
                at = np.minimum(at + step.astype(np.int64), words)
            out[:, r] = mix(key)
        return out


class Bitmap:
    """A set of 64-bit hashes by their leading bits, packed."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.shift = np.uint64(64 - bits)
        self.data = np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> self.shift
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def word_edits(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of two word lists, or most + 1 if it is larger."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _codes(windows: np.ndarray) -> list[str]:
    """One letter a word, by its hash: the letters' edit distance never passes that of the words."""
    letters = (windows % np.uint64(20_000)).astype(np.uint32) + np.uint32(0x4E00)
    return [row.tobytes().decode("utf-32-le") for row in letters]


def _windows(words: Words, window: int, good: np.ndarray | None = None) -> np.ndarray:
    """Starts of the windows inside one text; of those for which ``good`` holds, if it is given."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    one = words.text[:n] == words.text[window - 1 :]
    return np.flatnonzero(one if good is None else good[:n] & one)


def _run_length(window: int, edits: int) -> int:
    """Words of the longest run that ``edits`` edits of a window leave untouched, at least."""
    return max(1, -(-(window - edits) // (edits + 1)))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each word on; those at the end, which lack words, are left out."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def _item_index(items: DataFrame, walk: WalkHash, item_col: str, passage_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, texts in chunks(frame["t"].tolist()):
                words = Words(texts)
                start = _windows(words, walk.window)
                if not len(start):
                    continue
                hashes = words.hash[start[:, None] + np.arange(walk.window)]
                keys, codes = walk.keys(hashes), _codes(hashes)
                spelled = [words.spell(i, walk.window) for i in start]
                ids = frame["i"].to_numpy()[at + words.text[start]]
                for r in range(walk.repeats):
                    yield pd.DataFrame({"item_id": ids, "lsh_key": keys[:, r].view(np.int64), "item_words": spelled, "item_code": codes})

    chosen = items.select(F.col(item_col).cast("long").alias("i"), F.col(passage_col).alias("t")).filter("i is not null and t is not null")
    return chosen.mapInPandas(run, "item_id long, lsh_key long, item_words string, item_code string").distinct()


def _bitmaps(index: DataFrame, rows: int, run_length: int) -> tuple[Bitmap, Bitmap, Bitmap]:
    """Bitmaps of the index's words, runs and keys, about 16 bits a row; each task sends three of that size."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * rows + 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, parts, keys = (Bitmap(bits) for _ in range(3))
        for frame in frames:
            read = Words(frame["item_words"].drop_duplicates().tolist())
            words.add(read.hash)
            runs = _runs(read.hash, run_length)
            parts.add(runs[read.text[: len(runs)] == read.text[run_length - 1 :]])
            keys.add(frame["lsh_key"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"w": [words.data.tobytes()], "r": [parts.data.tobytes()], "k": [keys.data.tobytes()]})

    words, parts, keys = (Bitmap(bits) for _ in range(3))
    tasks = min(64, max(8, rows // 1_000_000))
    for row in index.select("item_words", "lsh_key").coalesce(tasks).mapInPandas(run, "w binary, r binary, k binary").toLocalIterator():
        for bitmap, column in ((words, "w"), (parts, "r"), (keys, "k")):
            bitmap.data |= np.frombuffer(row[column], np.uint8)
    return words, parts, keys


def leaks(docs: DataFrame, items: DataFrame, window: int = 13, edits: int = 0, recall: float = 0.95, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", broadcast_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """(doc_id, item_id, edits, windows): documents with a run of words within ``edits`` word edits of a passage window.

    ``edits`` of a row is the least found, ``windows`` the number of distinct passage windows met. Rows of
    0 edits are complete whatever ``edits`` is, as equal windows share every key; the others are found at
    the target recall. Passages of fewer than ``window`` words cannot leak. Null ids or texts give nothing,
    a repeated doc_id counts once, empty tables give no rows. The index is broadcast only if its texts and
    keys are measured to take at most ``broadcast_bytes``; else both sides are shuffled and the documents'
    side is salted against hot passages.
    """
    walk = WalkHash(window, edits, recall)
    spark = docs.sparkSession
    index = materialise(_item_index(items, walk, item_col, passage_col), "leak-index")
    # Text in the JVM's rows, keys and headers.
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("item_words") + F.octet_length("item_code") + 64).alias("b")).first()
    run_length = _run_length(window, edits)
    maps = spark.sparkContext.broadcast(_bitmaps(index, size["n"], run_length))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, parts, wanted = maps.value
        for frame in frames:
            ids = frame["d"].to_numpy()
            for at, texts in chunks(frame["t"].tolist()):
                words = Words(texts)
                counts = np.r_[0, np.cumsum(known.has(words.hash))]
                runs = np.zeros(len(words.hash) + 1, np.int64)
                starts = _runs(words.hash, run_length)
                np.cumsum(parts.has(starts), out=runs[1 : len(starts) + 1])
                runs[len(starts) + 1 :] = runs[len(starts)]
                for length in range(max(1, window - edits), window + edits + 1):
                    if len(words.hash) < length:
                        continue
                    # At most ``edits`` words of the longer side lack a partner.
                    good = counts[length:] - counts[:-length] >= max(length, window) - edits
                    # And a whole run of a passage lies inside.
                    reach = length - run_length + 1
                    good &= runs[reach : reach + len(good)] > runs[: len(good)]
                    start = _windows(words, length, good)
                    if not len(start):
                        continue
                    hashes = words.hash[start[:, None] + np.arange(length)]
                    keys = walk.keys(hashes)
                    hit = wanted.has(keys)
                    some = np.flatnonzero(hit.any(axis=1))
                    if len(some):
                        met = [k[h].tolist() for k, h in zip(keys[some].view(np.int64), hit[some], strict=True)]
                        yield pd.DataFrame({"doc_id": ids[at + words.text[start[some]]], "lsh_keys": met, "doc_words": [words.spell(start[k], length) for k in some], "doc_code": _codes(hashes[some])})

    chosen = docs.select(F.col(doc_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null and t is not null")
    found = spread(chosen).mapInPandas(run, "doc_id long, lsh_keys array<long>, doc_words string, doc_code string")
    found = found.select("doc_id", F.explode("lsh_keys").alias("lsh_key"), "doc_words", "doc_code")
    if (size["b"] or 0) <= broadcast_bytes:
        met = found.join(F.broadcast(index), "lsh_key")
    else:
        repeated = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(repeated, ["lsh_key", "salt"])
    met = met.filter(F.levenshtein("doc_code", "item_code", edits) >= 0)
    if edits == 0:
        sure = met.filter("doc_words = item_words").withColumn("edits", F.lit(0))
    else:
        # Where different words have different letters throughout a pair, the letters' distance is that of the words.
        distinct = lambda *parts: F.size(F.array_distinct(F.concat(*parts)))
        letters = lambda c: F.array_remove(F.split(c, ""), "")
        told = distinct(F.split("doc_words", " "), F.split("item_words", " ")) == distinct(letters("doc_code"), letters("item_code"))

        @F.pandas_udf("int")
        def distance(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([-1 if x is None else word_edits(x.split(), y.split(), edits) for x, y in zip(a, b, strict=True)], dtype="int32")

        pairs = met.select("doc_id", "item_id", "doc_words", "item_words", "doc_code", "item_code").distinct().withColumn("told", told)
        # Not deterministic by name only, so that it is evaluated once a pair and not once more for the filter.
        spelled = distance.asNondeterministic()(*[F.when(~F.col("told"), F.col(c)) for c in ("doc_words", "item_words")])
        sure = pairs.withColumn("spelled", spelled).withColumn("edits", F.when(F.col("told"), F.levenshtein("doc_code", "item_code")).otherwise(F.col("spelled"))).filter(F.col("edits") <= edits)
    by_window = sure.groupBy("doc_id", "item_id", "item_words").agg(F.min("edits").alias("edits"))
    return by_window.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count(F.lit(1)).alias("windows"))
