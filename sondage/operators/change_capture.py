"""Processing only new or changed records.

A log-based capture. ``valid_states`` folds the log of recorded states to the last one a successful run wrote.
``detect`` compares it with the current records. ``ChangeLog`` gives every change a place (partition, offset) in a
batch, writes the batch plan ahead of the work, replays an unfinished plan after a failure and delivers into a sink
that keeps each (key, partition, offset) once, so that a record is neither skipped nor repeated.

Cases: a path's rows of failed or running runs do not count; repeated rows count once; of different rows of one path
and run the greatest hash holds; a null text or a null hash always differs; modification times decide nothing; a null
path is no record; of a current path that occurs twice with different texts the path is changed unless all its texts
have the recorded hash; empty tables are no special case.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.storage import written


def valid_states(file_state: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, run_id, content_hash): the row of the latest run with outcome ok. Partial aggregation, no window."""
    ok = runs.where(F.lower(F.trim("outcome")) == "ok").select("run_id").where("run_id is not null").distinct()
    return (
        file_state.where("path is not null")
        .select("path", "run_id", F.lower(F.trim("content_hash")).alias("content_hash"))
        .join(ok, "run_id", "left_semi")
        .groupBy("path")
        .agg(F.max(F.struct("run_id", "content_hash")).alias("s"))
        .select("path", "s.run_id", "s.content_hash")
    )


def detect(documents: DataFrame, states: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """(path, status, content_hash): new, changed and deleted paths. Hashing runs before the shuffle, so no text moves."""
    now = (
        documents.where(F.col(path).isNotNull())
        .select(F.col(path).alias("path"), F.sha2(F.col(text).cast("binary"), 256).alias("h"))
        .groupBy("path")
        .agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max(F.col("h").isNull()).alias("gone"), F.lit(True).alias("here"))
    )
    old = states.select("path", F.col("content_hash").alias("was"), F.lit(True).alias("known"))
    same = ~F.col("gone") & F.col("low").eqNullSafe(F.col("high")) & (F.col("low") == F.col("was"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when(~F.coalesce(same, F.lit(False)), "changed")
    return (
        now.join(old, "path", "full_outer")
        .select("path", status.alias("status"), F.when(~F.col("gone"), F.col("high")).alias("content_hash"))
        .where("status is not null")
    )


class ChangeLog:
    """Batches of changes under ``root``: ``plan/<batch>`` and ``offsets/<batch>`` ahead of the work, ``done/<batch>`` after
    it, ``sink/<batch>``.

    Partitions are those of the batch: a change set of any size is range partitioned by path into as many as it needs, and
    a row's offset is its place in its partition. The offsets of a batch start where those of the batch before ended, which
    its ``offsets`` table tells, so no run reads history. A batch has one place in the sink and a replay writes it anew:
    the sink does not grow by replays. ``apply`` may run twice when a crash falls between it and the done mark, so it gets
    the batch's name to be idempotent by.

    A plan is complete once Spark has written its ``_SUCCESS`` file; a plan without one is made anew, since nothing was
    delivered from it. A complete plan without a done mark is replayed as it stands, whatever the sources say by then.
    """

    def __init__(self, spark: SparkSession, root: str, rows: int = 1_000_000):
        self.spark, self.root, self.rows = spark, root.rstrip("/"), rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _names(self, name: str) -> list[str]:
        if not self._has(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")))

    def batches(self) -> list[str]:
        return [b for b in self._names("plan") if self._has(f"plan/{b}/_SUCCESS") and self._has(f"offsets/{b}/_SUCCESS")]

    def pending(self) -> list[str]:
        return [b for b in self.batches() if not self._has(f"done/{b}")]

    def offsets(self) -> DataFrame:
        """(partition, next_offset) after the last complete plan: one row a partition that was ever used."""
        if not (found := self.batches()):
            return self.spark.createDataFrame([], "partition int, next_offset bigint")
        return self._read([f"offsets/{found[-1]}"])

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names])

    def plan(self, changes: DataFrame) -> str:
        """Write the next batch ahead of its work; returns its name. ``changes`` has path and status at least.

        Rows are cut into as many ranges of about ``rows`` as there are; places come from the order in a range.
        """
        batch = f"{len(self.batches()):012d}"
        found = written(changes, "found")
        parts = max(1, -(-found.count() // self.rows))
        cut = found.repartitionByRange(parts, "path", "status").sortWithinPartitions("path", "status")
        held = written(cut.withColumn("_at", F.monotonically_increasing_id()), "ordered")
        rows = held.withColumn("partition", F.shiftright("_at", 33).cast("int"))
        before = self.offsets()
        counts = rows.groupBy("partition").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
        bases = written(counts.join(before, "partition", "left").select("partition", "first", "n", F.coalesce("next_offset", F.lit(0)).alias("base")), "bases")
        out = rows.join(F.broadcast(bases.select("partition", "first", "base")), "partition").withColumn("offset", F.col("base") + F.col("_at") - F.col("first")).drop("_at", "first", "base")
        out.write.mode("overwrite").parquet(f"{self.root}/plan/{batch}")
        ended = bases.select("partition", (F.col("base") + F.col("n")).alias("next_offset"))
        ended.unionByName(before.join(bases, "partition", "left_anti")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/offsets/{batch}")
        return batch

    def deliver(self, apply=None) -> list[str]:
        """Replay every complete plan without a done mark, oldest first: ``apply(rows, batch)``, sink, done mark."""
        ran = []
        for batch in self.pending():
            rows = self._read([f"plan/{batch}"])
            if apply is not None:
                apply(rows, batch)
            rows.write.mode("overwrite").parquet(f"{self.root}/sink/{batch}")
            mark = self._fs.create(self._path(f"{self.root}/done/{batch}"), True)
            mark.write(bytearray(json.dumps({"batch": batch}).encode()))
            mark.close()
            ran.append(batch)
        return ran

    def sink(self, batch: str | None = None) -> DataFrame:
        """What was delivered, each key and offset once, however often a batch was replayed; of one batch or of all."""
        names = self._names("sink") if batch is None else [batch]
        if not (parts := [p for p in names if self._has(f"sink/{p}/_SUCCESS")]):
            return self.spark.createDataFrame([], "path string, status string, content_hash string, partition int, offset bigint")
        return self._read([f"sink/{p}" for p in parts]).dropDuplicates(["path", "partition", "offset"])

    def run(self, changes, apply=None) -> DataFrame:
        """One run: first what an earlier run left, then a plan of ``changes()`` taken after that; returns the sink."""
        self.deliver(apply)
        self.plan(changes())
        self.deliver(apply)
        return self.sink()
