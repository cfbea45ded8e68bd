"""Files of a directory tree as rows.

The tree is listed by the executors, which must see it: a shared folder on a cluster. Spark's own listing leaves out names
that start with an underscore, which source files do have; it serves other file systems than mounted ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.config import Config
from sondage.functions.paths import ignore_rules, is_excluded, is_watched, should_index
from sondage.operators.directory_rules import RULES, ruled
from sondage.storage import written

#: Names of files that say what to ignore below their directory, and one for the whole tree.
IGNORE_FILES, TREE_EXCLUDE = (".gitignore", ".ignore"), ".git/info/exclude"
_LISTED = "path string, modificationTime timestamp, length bigint, relative string"


def _mounted(root: str) -> str | None:
    """The root as a path of the operating system; None on another file system."""
    if root.startswith("file:"):
        return os.path.abspath("/" + root.removeprefix("file:").lstrip("/"))
    return None if "://" in root else os.path.abspath(root)


def entry(base: str, path: str) -> tuple:
    """(path, modificationTime, length, relative) of a file."""
    relative = os.path.relpath(path, base)
    try:
        found = os.lstat(path)
        return f"file:{path}", pd.Timestamp(found.st_mtime_ns // 1000, unit="us", tz="UTC"), found.st_size, relative
    except OSError:
        return f"file:{path}", pd.NaT, None, relative


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Entries as a frame of the listing's types."""
    out = pd.DataFrame(rows, columns=["path", "modificationTime", "length", "relative"])
    return out.astype({"modificationTime": "datetime64[us, UTC]", "length": "Int64"})


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, relative) of all files under ``root``, links not followed; a file that cannot be
    looked at has no length. The driver lists the root alone, the executors what is below."""
    base = _mounted(root)
    if base is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        plain = root.rstrip("/") + "/"
        return files.select("path", "modificationTime", "length", F.substr("path", F.lit(len(plain) + 1)).alias("relative"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for top in b["top"]:
                if not os.path.isdir(top) or os.path.islink(top):
                    if not os.path.islink(top):
                        yield frame([entry(base, top)])
                    continue
                for at, dirs, names in os.walk(top):
                    dirs[:] = [d for d in dirs if d != ".git"]
                    if names:
                        yield frame([entry(base, os.path.join(at, n)) for n in names if not os.path.islink(os.path.join(at, n))])

    tops = [os.path.join(base, n) for n in sorted(os.listdir(base)) if n != ".git"] + [os.path.join(base, TREE_EXCLUDE)]
    tops = [t for t in tops if os.path.lexists(t)]
    if not tops:
        return spark.createDataFrame([], _LISTED)
    cut = min(len(tops), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(t,) for t in tops], "top string").repartition(cut, "top").mapInPandas(walk, _LISTED)


def with_content(files: DataFrame) -> DataFrame:
    """The files that can be read, with ``content``; read by the executors, one narrow pass."""
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                try:
                    with open(path.removeprefix("file:"), "rb") as f:
                        found.append(f.read())
                except OSError:
                    found.append(None)
            b = b.assign(content=found)
            yield b[b["content"].notna()][[*names, "content"]]

    if (first := files.select("path").first()) is not None and "://" in first.path:
        content = files.sparkSession.read.format("binaryFile").load([r.path for r in files.select("path").collect()])
        return files.join(content.select("path", "content"), "path")
    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def _own_rules() -> str:
    """The ignore file of the user who runs the driver; '' where there is none."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    try:
        with open(os.path.join(home, "git", "ignore"), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def _rules(files: DataFrame, general: str) -> DataFrame:
    """(dir, line, regex, on) of the ignore files of a listing; ``general`` rules come before all others."""
    spark = files.sparkSession
    held = files.where((F.element_at(F.split("relative", "/"), -1).isin(*IGNORE_FILES) | (F.col("relative") == TREE_EXCLUDE)) & F.col("length").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for relative, content in zip(b["relative"], b["content"]):
                folder, first = ("", -100_000) if relative == TREE_EXCLUDE else (relative.rpartition("/")[0], 0)
                rows += [(folder, first + n, rx, on) for n, (rx, on) in enumerate(ignore_rules(content.decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["dir", "line", "regex", "on"])

    found = with_content(held.select("path", "relative")).mapInPandas(run, RULES)
    own = [("", n - 200_000, rx, on) for n, (rx, on) in enumerate(ignore_rules(general))]
    return found.unionByName(spark.createDataFrame(own, RULES)) if own else found


def scan(spark: SparkSession, root: str, config: Config | None = None, ignore_text: str | None = None) -> DataFrame:
    """(path, modificationTime, length, relative) of files under ``root`` that are not hidden, ignored or excluded.

    Ignore files hold for their directory, a deeper one before one further up. ``ignore_text`` are general rules that come
    before all of them, by default the user's own. No content but theirs is read.
    """
    config = config or Config()
    files = written(listing(spark, root), "listing")
    rules = written(_rules(files, _own_rules() if ignore_text is None else ignore_text), "rules")
    keep = files.where(F.col("length").isNotNull() & ~F.col("relative").rlike(r"(?:^|/)\.[^/]") & ~is_excluded(F.col("relative"), config.exclude_patterns))
    verdicts = ruled(keep.select("relative"), rules, "relative")
    return keep.join(verdicts.where("on").select("relative"), "relative", "left_anti").select("path", "modificationTime", "length", "relative")


def skipped(spark: SparkSession, root: str) -> int:
    """How many entries under ``root`` cannot be looked at."""
    return listing(spark, root).where("length is null").count()


def scan_simple(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files under ``root``, without rules."""
    return listing(spark, root).select("path")


def indexable(files: DataFrame, max_size: int) -> DataFrame:
    """Source files of a scan of at most ``max_size`` bytes; both tests reach the listing."""
    return files.where((F.col("length") <= max_size) & should_index(F.col("path"), F.col("length"), max_size))


def watched(files: DataFrame) -> DataFrame:
    """Files the watcher takes."""
    return files.where(is_watched(F.col("path")))


def latest_entries(entries: DataFrame) -> DataFrame:
    """(path, size, modified, seen_at): what the last scan saw of every path; a fold with partial aggregation."""
    newest = F.max(F.struct("seen_at", "modified", "size")).alias("e")
    return entries.where("path is not null").groupBy("path").agg(newest).select("path", "e.size", "e.modified", "e.seen_at")
