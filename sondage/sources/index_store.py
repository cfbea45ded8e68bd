"""The index as tables in a directory, kept in segments.

``segments/<n>/`` holds the rows a write brought (chunks, vectors, postings, file_state, cells) and what it took away
(gone_chunks, gone_paths); ``manifests/<n>.json`` lists the segments of version n. A row counts unless a later segment took
it away, so an update writes what changed and nothing else. A manifest gets its name, by a rename, when its segment is
complete, and the greatest manifest holds: there is no moment without a version, whenever a writer dies. After SEGMENTS
segments a write puts them together into one.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import INDEX_VERSION
from sondage.errors import IndexNotFound, IndexVersionMismatch
from sondage.operators import vector_search
from sondage.schemas import CELLS, CENTROIDS, CHUNKS, FILE_STATE, META, POSTINGS, VECTORS

TABLES = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "file_state": FILE_STATE}
#: Most segments before they are put together.
SEGMENTS = 16
_KEY = {"chunks": "id", "vectors": "chunk_id", "postings": "chunk_id", "cells": "chunk_id", "file_state": "path"}


def project_dir(index_dir: str, path: str) -> str:
    """A project's own directory: the first 16 hexadecimal digits of a hash of its path."""
    return f"{index_dir.rstrip('/')}/{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


class IndexStore:
    """Reads and writes the versions of one index. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int | None:
        """The number of the version that holds; None if there is none."""
        return max(self._versions(), default=None)

    def exists(self) -> bool:
        return self.current() is not None

    def manifest(self) -> dict:
        """What the version that holds consists of."""
        if (n := self.current()) is None:
            raise IndexNotFound(self.root)
        stream = self._fs.open(self._path(f"manifests/{n:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found.get("version") != INDEX_VERSION:
            raise IndexVersionMismatch(f"{self.root}: {found.get('version')}, not {INDEX_VERSION}")
        return found

    def read(self, name: str) -> DataFrame:
        """A table of the version that holds, in the order of its schema."""
        schema = {**TABLES, "cells": CELLS}[name]
        segments = self.manifest()["segments"]
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/segments/{n}/{name}") for n in segments]
        if len(segments) == 1:
            return parts[0]
        gone, key = ("gone_paths", "path") if name == "file_state" else ("gone_chunks", "chunk_id")
        taken = [self.spark.read.parquet(f"{self.root}/segments/{n}/{gone}").withColumn("until", F.lit(n)) for n in segments[1:]]
        last = reduce(DataFrame.unionByName, taken).groupBy(F.col(key).alias("gone")).agg(F.max("until").alias("until"))
        rows = reduce(DataFrame.unionByName, [p.withColumn("segment", F.lit(n)) for n, p in zip(segments, parts)])
        return rows.join(last, (F.col(_KEY[name]) == F.col("gone")) & (F.col("segment") < F.col("until")), "left_anti").select(*schema.fieldNames())

    def meta(self) -> DataFrame:
        found = self.manifest()
        return self.spark.createDataFrame([(found["version"], found["dimension"], found["chunk_count"], found["files"])], META)

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        """All tables; empty ones where there is no index yet."""
        there = self.exists()
        return {name: self.read(name) if there else self.empty(name) for name in TABLES}

    def centroids(self) -> DataFrame:
        """(cell, centroid): those the vectors' cells were made with."""
        return self.spark.read.schema(CENTROIDS).parquet(f"{self.root}/segments/{self.manifest()['centroids']}/centroids")

    def write(self, tables: dict[str, DataFrame], dimension: int, model: str = "") -> int:
        """Write a version of one segment and make it the one that holds."""
        n = (self.current() or 0) + 1
        self._write_rows(n, tables)
        base = f"{self.root}/segments/{n}"
        vectors = self.spark.read.schema(VECTORS).parquet(f"{base}/vectors")
        centroids = vector_search.fit_cells(vectors)
        centroids.write.mode("overwrite").parquet(f"{base}/centroids")
        self._write_cells(n, vectors, n)
        count, files = (self.spark.read.parquet(f"{base}/{name}").count() for name in ("chunks", "file_state"))
        return self._publish(n, {"dimension": dimension, "model": model, "chunk_count": count, "files": files, "segments": [n], "centroids": n})

    def append(self, fresh: dict[str, DataFrame], stale: DataFrame, paths: DataFrame, dimension: int, model: str = "") -> int:
        """Write a version that adds ``fresh`` rows after taking away the chunks ``stale`` (chunk_id) and the states of
        ``paths`` (path): one more segment, which holds these rows alone."""
        if not self.exists():
            return self.write(fresh, dimension, model)
        old = self.manifest()
        n = self.current() + 1
        base = f"{self.root}/segments/{n}"
        known = self.read("file_state").select("path")
        paths.select("path").distinct().write.mode("overwrite").parquet(f"{base}/gone_paths")
        stale.select("chunk_id").distinct().write.mode("overwrite").parquet(f"{base}/gone_chunks")
        self._write_rows(n, fresh)
        self._write_cells(n, self.spark.read.schema(VECTORS).parquet(f"{base}/vectors"), old["centroids"])
        taken = {name: self.spark.read.parquet(f"{base}/{name}") for name in ("gone_paths", "gone_chunks")}
        count = old["chunk_count"] - taken["gone_chunks"].count() + self.spark.read.parquet(f"{base}/chunks").count()
        files = old["files"] - known.join(taken["gone_paths"], "path", "left_semi").count() + self.spark.read.parquet(f"{base}/file_state").count()
        done = self._publish(n, {"dimension": dimension, "model": model or old["model"], "chunk_count": count, "files": files, "segments": [*old["segments"], n], "centroids": old["centroids"]})
        if len(old["segments"]) + 1 > SEGMENTS:
            return self.write(self.tables(), dimension, model or old["model"])
        return done

    def _write_rows(self, n: int, tables: dict[str, DataFrame]) -> None:
        for name, schema in TABLES.items():
            out = tables[name].select(*schema.fieldNames())
            if name == "postings":
                out = out.repartitionByRange("token").sortWithinPartitions("token", "chunk_id")
            out.write.mode("overwrite").parquet(f"{self.root}/segments/{n}/{name}")

    def _write_cells(self, n: int, vectors: DataFrame, centroids: int) -> None:
        """Vectors range partitioned by cell, so that a search reads the row groups of the cells it asks for."""
        made = self.spark.read.schema(CENTROIDS).parquet(f"{self.root}/segments/{centroids}/centroids")
        out = vector_search.in_cells(vectors, made).select(*CELLS.fieldNames())
        out.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("overwrite").parquet(f"{self.root}/segments/{n}/cells")

    def _publish(self, n: int, manifest: dict) -> int:
        """Give a complete manifest its name; a writer that dies before leaves the version before as it is."""
        stream = self._fs.create(self._path(f"manifests/{n:012d}.tmp"), True)
        stream.write(bytearray(json.dumps({"version": INDEX_VERSION} | manifest).encode()))
        stream.close()
        self._name(n)
        self._clean()
        return n

    def _name(self, n: int) -> None:
        if not self._fs.rename(self._path(f"manifests/{n:012d}.tmp"), self._path(f"manifests/{n:012d}.json")):
            raise OSError(f"version {n} of {self.root} is there already")

    def _clean(self) -> None:
        """Manifests before the last three go, and the segments that none of those left names."""
        versions = self._versions()
        for n in versions[:-3]:
            self._fs.delete(self._path(f"manifests/{n:012d}.json"), False)
        first = min((self._segments_of(n)[0] for n in versions[-3:]), default=0)
        for status in self._fs.listStatus(self._path("segments")):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < first:
                self._fs.delete(status.getPath(), True)

    def _segments_of(self, n: int) -> list[int]:
        stream = self._fs.open(self._path(f"manifests/{n:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["segments"]
        finally:
            stream.close()
