"""Session helpers: table access, shared scratch space and key normalisation."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, where they would not find it by themselves.

    On one machine they find it if its folder is on PYTHONPATH or is the working directory; on a cluster it
    is always sent.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    app = spark.sparkContext.applicationId
    found = os.path.realpath(os.getcwd()) == os.path.realpath(root) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _SHIPPED or (found and is_local(spark)):
        return
    folder = tempfile.mkdtemp(prefix="quillon-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillon", "zip", root, "quillon"))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine (a local master) may it be unset;
    then a temporary folder is chosen and set, and removed at the end. On a cluster a machine-local folder
    would lose what other machines write, so that an unset folder raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path) of the JVM for a path of any scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


_FOLDERS: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under one folder of this run, which is removed when the driver ends."""
    shared = shared_dir(spark).rstrip("/")
    key = (spark.sparkContext.applicationId, shared)
    if key not in _FOLDERS:
        fs, where = hadoop_path(spark, f"{shared}/quillon-{uuid.uuid4().hex}")
        # The file system marks only paths that exist, so the folder is made first.
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _FOLDERS[key] = f"{shared}/{where.getName()}"
    return f"{_FOLDERS[key]}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors. The table is removed when the
    driver ends.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blank_trim(col: Column) -> Column:
    """Trim all white space, not only U+0020."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def folded(col: Column) -> Column:
    """Key normal form: trimmed, lower case."""
    return F.lower(blank_trim(col))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over enough partitions for all cores.

    A scan of few files may be few row groups, whatever the number of its splits, and would leave cores
    idle in front of a costly narrow stage; only then are the rows shuffled once: when fewer than half of
    the cores would work. Others pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    if pieces <= 16 * cores:
        files = len(df.inputFiles())
        pieces = min(pieces, files) if files else pieces
    return df.repartition(2 * cores) if 2 * pieces < cores else df
