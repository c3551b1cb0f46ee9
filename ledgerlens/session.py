"""Session helpers: table access and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_ledgerlens_shipped", False):
        return
    top = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="ledgerlens-ship-"), "ledgerlens_package.zip")
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(packed))
    context._ledgerlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where that is unset, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as libraries other than Hadoop's need it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", found)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{qualified(spark, shared_dir(spark))}/ledgerlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in any file system known to Hadoop; a session that has ended is no error."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


#: Rows up to which a table that is compared with all rows is broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most so many rows; else Spark chooses how to join it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing that is still to run reads it."""
    if path := getattr(df, "scratch", None):
        remove(df.sparkSession, path)
