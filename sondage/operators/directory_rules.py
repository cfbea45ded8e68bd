"""Rules of files that hold for the directory they lie in, as ignore and attribute files do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "dir string, line int, regex string, on boolean"


def ruled(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """(path, on): the verdict of the rules (dir, line, regex, on) for those paths that any of them holds for.

    A deeper directory goes before one further up, and in a directory the last line that matches the path relative to it.
    A path meets the rules of each directory above it by an equality join, so neither the rules nor the files of a tree are
    gathered anywhere. The root's own directory is the empty text.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    one = paths.where(F.col(path).isNotNull()).select(path).distinct().select(path, F.explode(above).alias("dir"))
    rest = F.when(F.col("dir") == "", F.col(path)).otherwise(F.substr(F.col(path), F.length("dir") + 2))
    hits = one.join(rules.distinct(), "dir").where(F.rlike(rest, F.col("regex")))
    return hits.groupBy(path).agg(F.max_by("on", F.struct(F.length("dir"), "line", "regex")).alias("on"))
