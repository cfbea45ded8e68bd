"""Following changes of files.

Spark's file source reports neither changes of a known path nor deletions. Changes therefore come either as a stream of
events (path, op, ts, seq), or from a ticking stream whose micro-batches list the directory and compare it with the
recorded state. Micro-batches are the debounce: what arrives within one interval is handled together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sondage.config import Config
from sondage.operators.chunking import readable
from sondage.operators.embedding import Embedder, embedder_of
from sondage.plans.index import build_index, changed_rows
from sondage.sources.index_store import IndexStore
from sondage.sources.scan import entry, frame, watched, with_content
from sondage.storage import passing

#: Interval of the micro-batches.
DEBOUNCE = "500 milliseconds"
# What native events become.
OPERATIONS = {"create": "changed", "modify": "changed", "remove": "deleted"}


def convert_events(native: DataFrame) -> DataFrame:
    """(path, op, ts, seq) of native events (path, event, ts, seq): other events are dropped."""
    op = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    return native.withColumn("op", F.try_element_at(op, F.lower("event"))).where("op is not null").select("path", "op", "ts", "seq")


def last_events(events: DataFrame) -> DataFrame:
    """(path, op): the last event of every path, by time and then sequence."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))


def process_events(spark: SparkSession, events: DataFrame, index: str, embedder: Embedder | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Bring an index up to a batch of events by a segment of what changed; whether anything was written.

    Deletions and the old chunks of changed files go first. A changed file that cannot be read, or is no source text,
    is left out. ``read`` gives raw files (path, modificationTime, length, content) of paths.
    """
    store = IndexStore(spark, index)
    there = store.exists()
    embedder = embedder or embedder_of(store.manifest()["model"] if there else "")
    last = last_events(events).persist()
    try:
        if last.isEmpty():
            return False
        changed = last.where("op = 'changed'").select("path")
        files = (read or _read_files)(changed)
        with passing(spark):
            state = store.read("file_state") if there else store.empty("file_state")
            fresh, stale, paths = changed_rows(state, readable(watched(files)), last.select("path"), embedder)
            store.append(fresh, stale, paths, embedder.dimension, getattr(embedder, "name", ""))
        return True
    finally:
        last.unpersist()


def _read_files(paths: DataFrame) -> DataFrame:
    """Raw files of the paths that exist, read on the executors."""

    def stats(batches):
        for b in batches:
            bare = [p if p.startswith("file:") else f"file:{p}" for p in b["path"]]
            rows = [(p, *entry("/", q.removeprefix("file:"))[1:3]) for p, q in zip(b["path"], bare)]
            yield frame([(*r, "") for r in rows])[["path", "modificationTime", "length"]]

    found = paths.mapInPandas(stats, "path string, modificationTime timestamp, length bigint").where("length is not null")
    return with_content(found)


def watch_events(events: DataFrame, index: str, checkpoint: str, embedder: Embedder | None = None, interval: str | None = DEBOUNCE, read: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Follow a stream of events; ``interval`` None handles what there is and stops."""

    def batch(rows: DataFrame, _: int) -> None:
        process_events(rows.sparkSession, rows, index, embedder, read)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_directory(spark: SparkSession, root: str, index: str, checkpoint: str, config: Config | None = None, embedder: Embedder | None = None, interval: str = "2 seconds") -> StreamingQuery:
    """Follow a directory: every tick lists it, compares and indexes what changed; nothing is written if nothing did."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(_: DataFrame, __: int) -> None:
        build_index(spark, root, index, config, embedder)

    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(batch).start()
