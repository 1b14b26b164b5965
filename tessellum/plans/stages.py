"""Cutting a plan between stages: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local run where it is unset gets a folder of its own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessellum-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Where tables have been written.
_written: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(at)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes on disk from which a table between stages isn't broadcast: a packed table takes many times its bytes in the driver.
BROADCAST_BYTES = 1 << 18


def spread(df: DataFrame, name: str) -> DataFrame:
    """``stash`` for tables that are joined again and grow with the input: beyond ``BROADCAST_BYTES`` their joins are shuffled, so none of them passes through the driver."""
    got = stash(df, name)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_written[-1])
    size = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return got.hint("merge") if size > BROADCAST_BYTES else got


def drop_tables(spark: SparkSession) -> int:
    """Remove all tables that ``stash`` has written so far, and say how many; what still reads them must have been saved before."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessellum_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tessellum-code-"))
    at = os.path.join(folder, "tessellum_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(at)
    sc._tessellum_shipped = True
