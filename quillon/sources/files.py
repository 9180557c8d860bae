"""File sources and sinks: delimited with typed headers, XML rows, fixed width, packed binary, Parquet.

Formats are told by extension. Readers take one path, a glob or several; all files must have the same header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.ir import ModelError, Node
from quillon.session import hadoop_path, is_local, shared_dir

#: Type names of headers and their Spark types.
HEADER_TYPES = {"string": "string", "category": "string", "integer": "bigint", "int": "bigint", "int64": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
#: Packed binary formats and their Spark types.
PACKED = {"<i4": "int", "<i8": "bigint", "<f4": "float", "<f8": "double"}


def format_of(path: str, given: str | None = None) -> str:
    """csv, xml, nab or parquet by extension, unless given."""
    if given:
        return given.lower()
    end = path.rstrip("/").rpartition(".")[2].lower()
    kinds = {"avro": "avro", "csv": "csv", "tsv": "csv", "txt": "csv", "xml": "xml", "nab": "nab", "parquet": "parquet", "xtbl": "parquet"}
    if end not in kinds:
        raise ValueError(f"format of {path!r} is not known")
    return kinds[end]


def read_header(line: str, sep: str) -> list[tuple[str, str | None]]:
    """Names and types of a header whose fields may read ``name [type]``."""
    out = []
    for f in line.rstrip("\r\n").split(sep):
        m = re.fullmatch(r"\s*\"?(.*?)\"?\s*(?:\[(\w+)\]\s*)?", f)
        out.append((m[1].strip('" '), HEADER_TYPES[m[2].lower()] if m[2] else None))
    return out


def sniff(values: Sequence[str]) -> str:
    """Type of a column by sample values: bigint, double or string."""
    filled = [v for v in values if v not in ("", None)]
    for kind, fn in (("bigint", int), ("double", float)):
        try:
            [fn(v) for v in filled]
        except ValueError:
            continue
        if filled:
            return kind
    return "string"


_WHOLE, _REAL = r"^\s*[+-]?[0-9]{1,18}\s*$", r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*([+-]?inf(inity)?|nan)\s*$"


def infer_types(cells: DataFrame) -> dict[str, str]:
    """bigint, double or string for each string column, by all its rows: one aggregate, one row back.

    Null and empty cells count for nothing; a column without any other is a string.
    """
    if not cells.columns:
        return {}
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    tests = [F.every(filled(c).rlike(r)).alias(f"{k}_{i}") for i, c in enumerate(cells.columns) for k, r in (("w", _WHOLE), ("r", _REAL))]
    found = cells.agg(*tests).first()
    return {c: "bigint" if found[f"w_{i}"] else "double" if found[f"r_{i}"] else "string" for i, c in enumerate(cells.columns)}


def read_csv(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", types: dict[str, str] | None = None, bad: str = "keep") -> DataFrame:
    """Delimited files with a header in each.

    Types come from ``types``, the header's ``[type]``, or a pass over all rows, so that no cell is lost by
    a type that only the first rows have. ``bad`` tells what becomes of cells that fail a given type: keep
    (they become null), drop (their rows go) or fail. Headers of all files must agree.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    heads = lines.groupBy("f").agg(F.min_by("value", "n").alias("h"))
    seen = [r["h"] for r in heads.select("h").distinct().limit(2).collect()]
    if len(seen) != 1:
        raise ValueError("no header, or headers differ between files")
    header = read_header(seen[0], sep)
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", True)
    kinds = {n: (types or {}).get(n) or t for n, t in header}
    if open_ones := [n for n, k in kinds.items() if k is None]:
        texts = reader.schema(", ".join(f"`{n}` string" for n in kinds)).csv(paths)
        kinds |= infer_types(texts.select(*[F.col(f"`{n}`") for n in open_ones]))
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    mode = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[bad]
    return reader.option("mode", mode).schema(schema).csv(paths)


def stream_csv(spark: SparkSession, folder: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited files as a stream, each new file once; a stream's schema must be given."""
    return spark.readStream.option("header", header).option("sep", sep).schema(schema).csv(folder)


def stream_xml(spark: SparkSession, folder: str, schema: str, row: str = "row") -> DataFrame:
    """Row elements as a stream of text files with one element a line, as write_scores makes them."""
    return spark.readStream.text(folder).select(F.from_xml("value", schema, {"rowTag": row}).alias("r")).where("r is not null").select("r.*")


def stream_lines(spark: SparkSession, host: str, port: int, schema: str, kind: str = "csv", sep: str = ",") -> DataFrame:
    """Records a peer sends over a socket, one a line: delimited, JSON or one XML element."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    parsed = {"csv": lambda: F.from_csv("value", schema, {"sep": sep}), "json": lambda: F.from_json("value", schema), "xml": lambda: F.from_xml("value", schema)}[kind]()
    return lines.select(parsed.alias("r")).where("r is not null").select("r.*")


def read_framed(spark: SparkSession, paths: str | Sequence[str], schema: str, end: str = "</Event>", name: str = "Event") -> DataFrame:
    """XML elements in a byte stream without line structure, framed by their closing tag."""
    frames = spark.read.option("lineSep", end).text(paths)
    whole = F.concat(F.regexp_replace("value", rf"(?s)^.*?(?=<{name}[\s>])", ""), F.lit(end))
    return frames.where(F.col("value").rlike(rf"<{name}[\s>]")).select(F.from_xml(whole, schema, {"rowTag": name}).alias("r")).select("r.*")


def read_avro(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Avro files, if the session has Spark's avro module (``spark.jars.packages``); else a plain error says so."""
    try:
        reader = spark.read.format("avro")
        return (reader.option("avroSchema", schema) if schema else reader).load(paths)
    except Exception as err:
        if "avro" in str(err).lower():
            raise ValueError("Avro files need the module spark-avro on the session's class path") from err
        raise


def read_xml(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, row: str = "row") -> DataFrame:
    """Row elements of XML files; absent tags are null."""
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(paths)


def read_fixed(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[tuple[str, int, str]]) -> DataFrame:
    """Fixed-width lines: (name, width, type) of each field; blanks are trimmed, cells that fail become null."""
    cols, at = [], 1
    for name, width, kind in fields:
        text = F.trim(F.substring("value", at, width))
        cols.append((text if kind == "string" else text.try_cast(kind)).alias(name))
        at += width
    return spark.read.text(paths).select(*cols)


def read_nab(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Packed binary records after a line ``RecArray names=… formats=…``; each file is one task."""
    schema = ", ".join(f"`{n}` {PACKED[f]}" for n, f in fields)
    kind = np.dtype([(n, f) for n, f in fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame["content"]:
                head, _, body = bytes(blob).partition(b"\n")
                if not head.startswith(b"RecArray"):
                    raise ValueError("no RecArray header")
                yield pd.DataFrame(np.frombuffer(body, kind, len(body) // kind.itemsize).copy())

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.nab").load(paths).select("content").mapInPandas(run, schema)


def write_nab(df: DataFrame, path: str, fields: Sequence[tuple[str, str]]) -> None:
    """One packed file a partition, written by the tasks to any file system pyarrow knows by its URI.

    The folder must be new or empty: nothing in it is deleted. A task that is run again writes the same
    name again. Machine-local folders are refused on a cluster.
    """
    spark = df.sparkSession
    kind = np.dtype([(n, f) for n, f in fields])
    header = f"RecArray names={','.join(n for n, _ in fields)} formats={','.join(f for _, f in fields)}\n".encode()
    fs, where = hadoop_path(spark, path)
    if fs.exists(where) and len(fs.listStatus(where)):
        raise ValueError(f"{path} is not empty")
    if fs.getScheme() == "file" and not is_local(spark) and not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is local to each machine")
    fs.mkdirs(where)
    target = fs.makeQualified(where).toString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", target))
        name = f"{folder}/part-{task.partitionId():05d}"
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            out.write(header)
            for frame in frames:
                block = np.empty(len(frame), kind)
                for n, _ in fields:
                    block[n] = frame[n].to_numpy()
                out.write(block.tobytes())
        # Only a whole file gets the name that readers take.
        store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.nab")
        yield pd.DataFrame({"n": [1]})

    df.select(*[n for n, _ in fields]).mapInPandas(run, "n int").agg(F.sum("n")).collect()


def write(df: DataFrame, path: str, kind: str | None = None, **options: str) -> None:
    """csv, xml or parquet."""
    kind = format_of(path, kind)
    writer = df.write.mode("overwrite").options(**options)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "xml":
        writer.format("xml").option("rowTag", options.get("rowTag", "row")).save(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {kind}")


def write_scores(scored: DataFrame, path: str, kind: str = "xml", name: str = "Event") -> None:
    """Score records as XML elements or JSON lines."""
    record = F.struct(*[F.col(c) for c in scored.columns])
    # Line breaks between elements go; those inside a value travel as character references.
    line = F.to_json(record) if kind == "json" else F.regexp_replace(F.regexp_replace(F.to_xml(record, {"rowTag": name}), r">\s*\n\s*<", "><"), r"\r?\n", "&#10;")
    scored.select(line.alias("value")).write.mode("overwrite").text(path)


def read_scores(spark: SparkSession, path: str, schema: str, kind: str = "xml", name: str = "Event") -> DataFrame:
    """Reads what write_scores wrote."""
    if kind == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).select(F.from_xml("value", schema, {"rowTag": name}).alias("r")).select("r.*")


def read_jdbc(spark: SparkSession, url: str, dbtable: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with a whole-number key, read in parts by ranges of it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    kind = format_of(path, kind)
    readers = {"avro": read_avro, "csv": read_csv, "xml": read_xml, "nab": read_nab, "parquet": lambda s, p: s.read.parquet(p)}
    return readers[kind](spark, path, **options)


def check_fields(df: DataFrame, doc: Node) -> DataFrame:
    """The frame, if it has every field the model declares."""
    dictionary = doc.first("DataDictionary")
    absent = [f.need("name") for f in dictionary.all("DataField") if f.need("name") not in df.columns] if dictionary else []
    if absent:
        raise ModelError(f"the input lacks {', '.join(absent)}")
    return df
