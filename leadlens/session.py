"""Session helpers: settings, table loading and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Runtime settings; none of them depends on the size of the data.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "leadlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; extra settings go by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of Parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset a temporary one is set on a local master, and a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leadlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/leadlens/{label}-{os.getpid()}-{uuid.uuid4().hex}"


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file."""
    files, target = _file_system(spark, path)
    return files.exists(target) and files.getFileStatus(target).isFile()


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it lives on."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def make_dir(spark: SparkSession, path: str) -> None:
    """Make a folder, if it is not there."""
    files, target = _file_system(spark, path)
    files.mkdirs(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    files, target = _file_system(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """Read a small file."""
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it lives on."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once everything that reads it is written itself."""
    for df in written:
        if path := getattr(df, "shared_path", None):
            drop_path(df.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """Have the driver drop what it no longer uses: shuffle files of finished jobs go with it, which else stay until it happens to be short of memory."""
    gc.collect()
    # Py4J tells the driver of objects that Python let go in a thread of its own, which looks once a second
    told, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 3
    while told and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def together(*jobs: Callable[[], T]) -> list[T]:
    """The results of jobs that do not wait for each other, run at the same time."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(own(j)) for j in jobs]]


def small_rows(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a table that is small by definition, such as a dimension; a larger one is refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows was expected")
    return rows
