"""Rows that fail to parse: typed rows on one side, rejects with a reason on the other.

Each Arrow batch of raw lines is parsed at once by the pyarrow CSV reader. Its invalid-row callback
collects the rows of a wrong width, all fields are read as strings, and the cell checks are vectorised.
Lines whose quoting is broken would swallow their neighbours inside the reader, so one RE2 match per
batch sets them apart first. There is no shuffle: the work is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import spread

WELL_QUOTED = r'^(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*$'
BOM = "\ufeff"
ESCAPE = "\ue000"


@dataclass(frozen=True)
class Feed:
    """Layout of one feed: its columns in file order and how each is read (``text``, ``count``, ``day``)."""

    name: str
    columns: tuple[tuple[str, str], ...]

    @property
    def header(self) -> str:
        return "\t".join(c for c, _ in self.columns)


FEEDS = (
    Feed("test_data", (("sensor", "text"), ("volume", "count"))),
    Feed("wtraining_converted", (("Count", "count"), ("Date", "day"), ("Color", "text"), ("Automaker", "text"))),
)


def out_schema(feeds: tuple[Feed, ...]) -> str:
    typed = {"text": "string", "count": "long", "day": "date"}
    cols = {c.lower(): typed[k] for f in feeds for c, k in f.columns}
    return "line_id long, feed string, reason string, bad_field string, " + ", ".join(f"`{c}` {t}" for c, t in cols.items())


def _day(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Dates of a string array in yyyy-mm-dd, and which entries are no real day. Empty is null and sound."""
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    shaped = pc.match_substring_regex(text, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").to_numpy(zero_copy_only=False)
    safe = pc.if_else(pa.array(shaped), text, "2000-01-01")
    y, m, d = (pc.cast(pc.utf8_slice_codeunits(safe, a, b), pa.int32()).to_numpy() for a, b in ((0, 4), (5, 7), (8, 10)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    real = shaped & (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length)
    days = pc.cast(pc.if_else(pa.array(real & ~empty), safe, None), pa.date32())
    return days, ~real & ~empty


def _count(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    sound = pc.match_substring_regex(text, r"^[0-9]{1,9}$").to_numpy(zero_copy_only=False)
    return pc.cast(pc.if_else(pa.array(sound), text, None), pa.int64()), ~sound & ~empty


def parse_lines(ids: pa.Array, lines: pa.Array, feed: Feed, schema: pa.Schema) -> pa.Table:
    """Parse the lines of one feed. Every line but headers and blanks comes out once, with a reason or typed."""
    lines = pc.fill_null(lines, "")
    lines = pc.replace_substring_regex(lines, "\r$", "")
    lines = pc.if_else(pc.starts_with(lines, BOM), pc.utf8_slice_codeunits(lines, 1), lines)
    blank = pc.match_substring_regex(lines, "^ *$")
    keep = pc.invert(pc.or_(blank, pc.equal(lines, feed.header)))
    ids, lines = ids.filter(keep), lines.filter(keep)
    quoted_well = pc.match_substring_regex(lines, f"(?s){WELL_QUOTED}")
    bad_quote = ids.filter(pc.invert(quoted_well))
    ids, lines = ids.filter(quoted_well), lines.filter(quoted_well)
    # The reader ends rows at any CR or LF; those inside a line travel under an escape.
    odd = len(lines) > 0 and pc.any(pc.match_substring_regex(lines, "[\r\n]")).as_py()
    if odd:
        for a, b in ((ESCAPE, ESCAPE + "0"), ("\n", ESCAPE + "1"), ("\r", ESCAPE + "2")):
            lines = pc.replace_substring(lines, a, b)
    wrong: list[int] = []

    def reject(row: pacsv.InvalidRow) -> str:
        wrong.append(int(row.text.split("\t", 1)[0].strip('"')))
        return "skip"

    names = ["row", *(c for c, _ in feed.columns)]
    n = len(lines)
    if n:
        places = pc.cast(pa.array(np.arange(n)), pa.string())
        data = "\n".join(pc.binary_join_element_wise(places, lines, "\t").to_pylist()).encode() + b"\n"
        parsed = pacsv.read_csv(
            pa.py_buffer(data),
            read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 1),
            parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
            convert_options=pacsv.ConvertOptions(column_types={"row": pa.int64(), **dict.fromkeys(names[1:], pa.string())}, strings_can_be_null=False),
        ).combine_chunks()
    else:
        parsed = pa.table({"row": pa.array([], pa.int64()), **{c: pa.array([], pa.string()) for c in names[1:]}})
    at = parsed.column("row").combine_chunks()
    out: dict[str, pa.Array] = {"line_id": ids.take(at)}
    bad = np.full(len(at), -1)
    for k, (name, kind) in enumerate(feed.columns):
        text = parsed.column(name).combine_chunks()
        if odd:
            for a, b in ((ESCAPE + "2", "\r"), (ESCAPE + "1", "\n"), (ESCAPE + "0", ESCAPE)):
                text = pc.replace_substring(text, a, b)
        if kind == "text":
            out[name.lower()] = text
            continue
        values, fails = (_day if kind == "day" else _count)(pc.utf8_trim(text, " "))
        out[name.lower()] = values
        bad = np.where((bad < 0) & fails, k, bad)
    labels = pa.array([c.lower() for c, _ in feed.columns])
    failing = pa.array(bad >= 0)
    out["bad_field"] = pc.if_else(failing, labels.take(pa.array(np.maximum(bad, 0))), None)
    out["reason"] = pc.if_else(failing, "value", pa.scalar(None, pa.string()))
    good = pa.table({f.name: pc.cast(out[f.name], f.type) if f.name in out else pa.nulls(len(at), f.type) for f in schema if f.name != "feed"})
    rejects = pa.concat_arrays([bad_quote, ids.take(pa.array(wrong, pa.int64()))]) if wrong or len(bad_quote) else bad_quote
    reasons = pa.array(["quoting"] * len(bad_quote) + ["columns"] * len(wrong), pa.string())
    bads = pa.table({f.name: rejects if f.name == "line_id" else reasons if f.name == "reason" else pa.nulls(len(rejects), f.type) for f in schema if f.name != "feed"})
    both = pa.concat_tables([good, bads])
    return both.add_column(1, "feed", pa.array([feed.name] * len(both), pa.string())).select(schema.names)


def split_lines(df: DataFrame, feeds: tuple[Feed, ...] = FEEDS, id_col: str = "line_id", feed_col: str = "feed", text_col: str = "line_text", unknown: bool = False) -> DataFrame:
    """One row for each data line: ``reason`` is null and the typed columns filled, or it names the fault.

    ``reason`` is the first of ``quoting``, ``columns``, ``value`` that applies; ``bad_field`` the first
    failing cell of a ``value`` fault. Headers, empty lines, lines of spaces and null lines give no row;
    lines of an unknown or null feed give none either, or with ``unknown`` come out with the reason ``feed``. Null ids are kept as null. Other columns of the
    input are ignored, whatever their names. An empty table gives an empty table.
    """
    text = out_schema(feeds)
    kinds = {"text": pa.string(), "count": pa.int64(), "day": pa.date32()}
    cols = {c.lower(): kinds[k] for f in feeds for c, k in f.columns}
    schema = pa.schema([("line_id", pa.int64()), ("feed", pa.string()), ("reason", pa.string()), ("bad_field", pa.string()), *cols.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if unknown:
                known = pc.fill_null(pc.is_in(batch.column(1), pa.array([f.name for f in feeds])), False)
                other = batch.filter(pc.and_(pc.invert(known), pc.is_valid(batch.column(2))))
                columns = {"line_id": other.column(0), "feed": pc.cast(other.column(1), pa.string()), "reason": pa.array(["feed"] * other.num_rows, pa.string())}
                yield from pa.table({f.name: columns.get(f.name, pa.nulls(other.num_rows, f.type)) for f in schema}).to_batches()
            for feed in feeds:
                mine = batch.filter(pc.equal(batch.column(1), feed.name))
                if mine.num_rows:
                    yield from parse_lines(mine.column(0), pc.cast(mine.column(2), pa.string()), feed, schema).to_batches()

    rows = df.select(F.col(id_col).cast("long"), F.col(feed_col), F.col(text_col))
    chosen = rows if unknown else rows.filter(F.col(feed_col).isin([f.name for f in feeds]))
    return spread(chosen).mapInArrow(run, text)


def rejects(parsed: DataFrame) -> DataFrame:
    """The distinct rejected lines with their reason. Partial aggregation comes before the shuffle."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def sound_rows(parsed: DataFrame, feed: Feed) -> DataFrame:
    """The typed rows of one feed, each line_id once."""
    cols = [c.lower() for c, _ in feed.columns]
    return parsed.filter(F.col("reason").isNull() & (F.col("feed") == feed.name)).select("line_id", *cols).dropDuplicates(["line_id"])
