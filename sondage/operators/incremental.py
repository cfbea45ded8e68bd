"""Which files changed since the recorded state, and keeping that state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.schemas import FILE_STATE


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], FILE_STATE)


def detect_changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status) with status changed, unchanged or deleted.

    ``files`` has path, mtime and content_hash; it may be lazy in the hash, which is looked at only where the time of a
    known path differs. A new path, and one whose hash is null because it cannot be read, is changed.
    """
    now = files.select("path", F.col("mtime").alias("now_mtime"), F.col("content_hash").alias("now_hash"), F.lit(True).alias("here"))
    was = state.select("path", "mtime", "content_hash", F.lit(True).alias("known"))
    same = (F.col("now_mtime") == F.col("mtime")) | (F.lower("now_hash") == F.lower("content_hash"))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNotNull() & F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return now.join(was, "path", "full_outer").select("path", status.alias("status"))


def update_files(state: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The state with rows of ``files`` (path, mtime, content_hash) in place of the old, with their chunks' ids.

    A null time is recorded as the epoch. The ids of one file meet in one row, as many as the file has chunks.
    """
    ids = chunks.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_set("id")).alias("chunk_ids"))
    fresh = files.select("path", F.coalesce("mtime", F.timestamp_seconds(F.lit(0))).alias("mtime"), "content_hash").join(ids, "path", "left")
    fresh = fresh.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))
    columns = ["path", "mtime", "content_hash", "chunk_ids"]
    return remove_files(state, files).select(columns).unionByName(fresh.select(columns))


def remove_files(state: DataFrame, paths: DataFrame) -> DataFrame:
    """The state without the given paths."""
    return state.join(paths.select("path"), "path", "left_anti")


def chunk_ids_of(state: DataFrame, paths: DataFrame) -> DataFrame:
    """(chunk_id) of the given paths; unknown paths have none."""
    return state.join(paths.select("path"), "path", "left_semi").select(F.explode("chunk_ids").alias("chunk_id"))


def apply_deletions(state: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without the given paths, and the ids of the chunks they had."""
    return remove_files(state, paths), chunk_ids_of(state, paths)
