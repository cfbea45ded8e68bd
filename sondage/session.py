"""Spark sessions for the command line, tests and benchmarks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """See to it, once per application, that Python workers can import this package: send it where they cannot."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    name = __name__.partition(".")[0]
    # Made in the main module's name, so that it travels by value.
    probe = eval(f"lambda _: __import__('importlib.util').util.find_spec({name!r}) is not None", {"__name__": "__main__"})
    if not all(context.parallelize([0], 1).map(probe).collect()):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix=f"{name}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(str(Path(folder) / name), "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)


def session(name: str = "sondage", cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution; on a cluster take the session that is there.

    The low cost of opening a file lets a scan of few megabytes have a split per row group.
    """
    return (
        SparkSession.builder.appName(name)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
