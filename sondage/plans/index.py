"""Building and updating an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.config import Config
from sondage.operators import incremental
from sondage.operators.chunking import chunk_files, readable
from sondage.operators.embedding import Embedder, embed, embedder_of
from sondage.operators.postings import build_postings
from sondage.operators.summary import summaries
from sondage.sources.index_store import IndexStore
from sondage.sources.scan import indexable, scan, with_content
from sondage.storage import passing, written


def build_tables(files: DataFrame, embedder: Embedder) -> dict[str, DataFrame]:
    """Chunks, vectors, postings and state of files (file_path, text, mtime): a full build.

    Chunks are written once and read by the three tables made from them. Vectors are those of the summaries.
    """
    chunks = written(chunk_files(files), "chunks")
    state = files.select(F.col("file_path").alias("path"), "mtime", incremental.content_hash(F.col("text")).alias("content_hash"))
    empty = incremental.empty_state(files.sparkSession)
    return {
        "chunks": chunks,
        "vectors": embed(summaries(chunks), embedder),
        "postings": build_postings(chunks),
        "file_state": incremental.update_files(empty, state, chunks),
    }


def changed_rows(state: DataFrame, files: DataFrame, gone: DataFrame, embedder: Embedder) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """What indexing ``files`` anew and dropping the paths of ``gone`` (path) comes to: fresh rows of all tables, the
    stale chunks (chunk_id) and the paths whose state goes."""
    fresh = build_tables(files, embedder)
    paths = written(files.select(F.col("file_path").alias("path")).unionByName(gone.select("path")).distinct(), "paths")
    stale = written(incremental.chunk_ids_of(state, paths).distinct(), "stale")
    return fresh, stale, paths


def build_index(spark: SparkSession, root: str, index: str, config: Config | None = None, embedder: Embedder | None = None, force: bool = False) -> dict[str, int]:
    """Index the source files under ``root`` into the directory ``index``; only changed ones unless ``force``.

    Content is read of new files and of those whose time differs; an equal file gets its new time recorded, so it is not
    read again. Returns how many files were changed, deleted and left as they were, and how many chunks there are. What is
    written is what changed, nothing if nothing did.
    """
    config = config or Config()
    embedder = embedder or embedder_of(config.model)
    with passing(spark):
        return _build(spark, root, IndexStore(spark, index), config, embedder, force)


def _build(spark: SparkSession, root: str, store: IndexStore, config: Config, embedder: Embedder, force: bool) -> dict[str, int]:
    model = getattr(embedder, "name", "")
    there = store.exists() and not force
    state = store.read("file_state") if there else store.empty("file_state")
    listed = indexable(scan(spark, root, config), config.max_file_size)
    known = state.select("path", F.col("mtime").alias("was"))
    touched = listed.join(known, "path", "left").where(F.col("was").isNull() | (F.col("was") != F.col("modificationTime")))
    read = written(readable(with_content(touched.drop("was"))), "files")
    hashes = read.select(F.col("file_path").alias("path"), incremental.content_hash(F.col("text")).alias("content_hash"))
    current = listed.select("path", F.col("modificationTime").alias("mtime")).join(hashes, "path", "left")
    status = written(incremental.detect_changes(current, state), "status")
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}

    def of(kind: str) -> DataFrame:
        return read.join(status.where(F.col("status") == kind).select(F.col("path").alias("file_path")), "file_path", "left_semi")

    touched_only = written(state.drop("mtime").join(of("unchanged").select(F.col("file_path").alias("path"), "mtime"), "path").select(state.columns), "touched")
    refreshed = not touched_only.isEmpty()
    if not there or counts.get("changed") or counts.get("deleted") or refreshed:
        fresh, stale, paths = changed_rows(state, of("changed"), status.where("status = 'deleted'").select("path"), embedder)
        if there:
            fresh["file_state"] = fresh["file_state"].unionByName(touched_only)
            store.append(fresh, stale, paths.unionByName(touched_only.select("path")), embedder.dimension, model)
        else:
            store.write(fresh, embedder.dimension, model)
    return {"changed": counts.get("changed", 0), "deleted": counts.get("deleted", 0), "unchanged": counts.get("unchanged", 0), "chunks": store.meta().first().chunk_count}


def index_status(spark: SparkSession, index: str) -> dict:
    """Whether there is an index, its version, its dimension and how many chunks and files it holds."""
    store = IndexStore(spark, index)
    if not store.exists():
        return {"exists": False, "version": None, "embedding_dim": None, "chunk_count": 0, "files": 0}
    return {"exists": True} | store.meta().first().asDict()
