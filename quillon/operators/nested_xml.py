"""Deeply nested records to flat tables that keep their parent links.

One depth-first pass of an expat visitor over each file emits tagged rows: a table tag, a primary key, a
parent key and a payload. Files are independent, so the pass is one narrow stage; the tagged rows are
written partitioned by tag and read back under each table's own schema, so that every file is parsed once
whatever the number of tables.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import spread

TAGGED = "origin string, file_name string, tag string, pk string, parent_pk string, payload string"


class _Visitor:
    """Collects (tag, pk, parent_pk, payload) of one document; ``frames`` is the open path of elements."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str, dict]] = []
        self.frames: list[dict] = []

    def parse(self, text: str) -> list[tuple[str, str, str, dict]] | None:
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        try:
            p.Parse(text, True)
        except (expat.ExpatError, UnicodeEncodeError):
            return None
        return self.rows

    def end(self, _name: str) -> None:
        self.frames.pop()


class ModelVisitor(_Visitor):
    """Segments and field-value counts of a model file."""

    def start(self, name: str, attrs: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        up = self.frames[-1] if self.frames else {"path": "", "inside": False, "segments": 0}
        path, inside = up["path"], up["inside"]
        if name == "Segment":
            up["segments"] += 1
            key = attrs["id"] if "id" in attrs else f"#{up['segments']}"
            own = f"{path}/{key}" if inside else key
            self.rows.append(("segment", own, path, attrs))
            path, inside = own, True
        elif name == "FieldValueCount":
            self.rows.append(("count", f"{attrs.get('field', '')}={attrs.get('value', '')}", path, attrs))
        self.frames.append({"path": path, "inside": inside, "segments": 0})


class ConfigVisitor(_Visitor):
    """Segmentation dimensions and their bins of a configuration file."""

    def start(self, name: str, attrs: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        up = self.frames[-1] if self.frames else {"kind": "", "path": "", "seen": Counter()}
        kind, path = "", ""
        if name == "SegmentationSchema":
            kind = "schema"
        elif up["kind"] == "schema":
            up["seen"][name] += 1
            kind, path = "group", f"{name}#{up['seen'][name]}"
        elif up["kind"] == "group" and name.endswith("Dimension"):
            kind, path = "dimension", f"{up['path']}/{attrs.get('field', '')}"
            self.rows.append(("dimension", path, up["path"], {**attrs, "element": name}))
        elif up["kind"] == "dimension" and name in ("Selection", "Partition"):
            label = attrs.get("value", "") if name == "Selection" else f"{attrs.get('low', '')}..{attrs.get('high', '')}"
            self.rows.append(("bin", f"{up['path']}/{label}", up["path"], {**attrs, "element": name}))
        self.frames.append({"kind": kind, "path": path, "seen": Counter()})


VISITORS = {"models": ModelVisitor, "configs": ConfigVisitor}


def tagged_rows(df: DataFrame, origin: str, name_col: str, text_col: str) -> DataFrame:
    """Tagged emission of one origin (``models`` or ``configs``).

    Null or not well-formed content gives no rows; a null file name stays null; empty tables give none.
    Other columns are ignored. ``payload`` holds all attributes as JSON, so optional fields survive.
    """
    visitor = VISITORS[origin]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file_name, text in zip(frame["n"], frame["x"], strict=True):
                for tag, pk, parent, payload in visitor().parse(text) or ():
                    out.append((origin, file_name, tag, pk, parent, json.dumps(payload, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["origin", "file_name", "tag", "pk", "parent_pk", "payload"])

    chosen = df.select(F.col(name_col).alias("n"), F.col(text_col).alias("x")).filter(F.col("x").isNotNull())
    return spread(chosen).mapInPandas(run, TAGGED)


def write_tables(tagged: DataFrame, path: str) -> DataFrame:
    """Writes the emission partitioned by tag and reads it back: each table then scans its own partition only.

    An empty emission reads back as an empty one.
    """
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)
    return tagged.sparkSession.read.schema(tagged.schema).parquet(path)


SCHEMAS = {
    "segment": {"weight": "double", "id": "string"},
    "count": {"field": "string", "value": "string", "count": "double"},
    "dimension": {"element": "string", "field": "string"},
    "bin": {"element": "string", "value": "string", "low": "string", "high": "string", "closure": "string"},
}


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag under its schema: origin, file_name, pk, parent_pk and typed payload columns."""
    rows = tagged.filter(F.col("tag") == tag).distinct()
    cols = [F.expr(f"try_cast(get_json_object(payload, '$.{c}') as {t})").alias(f"{tag}_{c}") for c, t in SCHEMAS[tag].items()]
    return rows.select("origin", "file_name", "pk", "parent_pk", *cols)
