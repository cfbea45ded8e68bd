"""Where intermediate tables live, so that a lost executor costs a re-read and never a re-run of the whole lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder of its own; a session on a cluster gets an error, as a
    machine-local folder there would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    set_dir = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sondage-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_MADE = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at its end: for work whose result is written by then."""
    outer, _MADE.paths = getattr(_MADE, "paths", None), []
    try:
        yield
    finally:
        made, _MADE.paths = _MADE.paths, outer
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted at the end of ``passing``, else when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    if getattr(_MADE, "paths", None) is not None:
        _MADE.paths.append(path)
    return path


def written(df: DataFrame, what: str = "step", sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
