"""Nearest vectors by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_K = 20
#: Queries that one exact batch search takes, as they are sent to all tasks.
MOST_QUERIES = 16_384


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of one length, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0.0 for empty vectors, different lengths or a zero norm."""
    norms = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norms > 0), dot(a, b) / F.when(norms > 0, norms)).otherwise(0.0)


def unit_distance(a: Column, b: Column) -> Column:
    """1 - dot: the distance of vectors that are known to be of unit length."""
    return F.lit(1.0) - dot(a, b)


def normalised(vectors: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """Vectors of unit length; those of zero length unchanged."""
    length = norm(F.col(vector_column))
    return vectors.withColumn(vector_column, F.when(length > 0, F.transform(vector_column, lambda x: (x / length).cast("float"))).otherwise(F.col(vector_column)))


def search_vector(vectors: DataFrame, query: Sequence[float], top_k: int = TOP_K, threshold: float = 0.0, unit: bool = False, repeated: bool = False, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """(chunk_id, score): exact search. The query is a literal, its norm a constant; the top is kept per task.

    The threshold is applied to the top, which leaves the same rows and computes each score once. Where rows may be
    ``repeated``, ids and scores are shuffled once, vectors never; the best score of an id counts.
    """
    q = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in q))
    v = F.col(vector_column)
    if not q or length == 0:
        score = F.lit(0.0)
    else:
        terms = F.array(*[F.lit(x) for x in q])
        own = F.lit(1.0) if unit else norm(v)
        score = F.when((F.size(v) == len(q)) & (own > 0), dot(v, terms) / F.when(own > 0, own * F.lit(length))).otherwise(0.0)
    scored = vectors.select(F.col(id_column).alias("chunk_id"), F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("score"))
    if repeated:
        scored = scored.groupBy("chunk_id").agg(F.max("score").alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return best.where(F.col("score") >= threshold)


#: Vectors that cells are fitted on, most cells, rounds of the fit; share and least number of the cells a search looks into.
FIT_ROWS, MOST_CELLS, FIT_ROUNDS, PROBED, LEAST_PROBED = 20_000, 1024, 8, 0.5, 16


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column with ``dim`` elements, as unit vectors, and which they are; zero and NaN rows stay out."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    fits = np.flatnonzero((sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    m = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dim)
    length = np.linalg.norm(m, axis=1)
    good = np.isfinite(length) & (length > 0)
    return m[good] / length[good, None], fits[good]


def fit_cells(vectors: DataFrame, seed: int = 7, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """(cell, centroid): spherical k-means on at most FIT_ROWS vectors, chosen by the hash of their ids; all rows are put
    into cells later. There are about sqrt(rows) cells, MOST_CELLS at most, so the driver's share is bounded."""
    spark = vectors.sparkSession
    n = vectors.where(F.col(vector_column).isNotNull()).count()
    hashed = F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(1 << 40))
    cut = int(min(1.0, 1.2 * FIT_ROWS / max(n, 1)) * (1 << 40))
    sample = vectors.where(F.col(vector_column).isNotNull() & (hashed < cut)).orderBy(hashed, id_column).limit(FIT_ROWS).select(vector_column).toArrow().column(0).combine_chunks()
    sizes = np.diff(sample.offsets.to_numpy()) if len(sample) else np.zeros(0, int)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    x = _matrix(sample, dim)[0] if dim else np.empty((0, 1))
    cells = int(min(MOST_CELLS, max(1, round(math.sqrt(n))), max(len(x), 1)))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)] if len(x) else np.zeros((0, dim))
    for _ in range(FIT_ROUNDS if len(x) else 0):
        nearest = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centroid array<float>")


def _centres(centroids: DataFrame) -> np.ndarray:
    """At most MOST_CELLS rows for the driver."""
    rows = sorted(centroids.limit(MOST_CELLS).collect(), key=lambda r: r.cell)
    return np.array([r.centroid for r in rows], np.float64) if rows else np.empty((0, 0))


def in_cells(vectors: DataFrame, centroids: DataFrame, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """(cell, chunk_id, embedding): every vector in the cell of its nearest centroid; -1 for those without a direction
    and those of another length. One narrow pass."""
    centres = _centres(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            if len(centres):
                unit, rows = _matrix(b.column(1), centres.shape[1])
                cell[rows] = (unit @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], names=["cell", "chunk_id", "embedding"])

    source = vectors.select(F.col(id_column).cast("bigint").alias("chunk_id"), F.col(vector_column).cast("array<float>").alias("embedding"))
    return source.mapInArrow(run, "cell int, chunk_id bigint, embedding array<float>")


def _looked(cells: int, share: float) -> int:
    return max(LEAST_PROBED, math.ceil(share * cells))


def probes(centres: np.ndarray, query: Sequence[float], share: float = PROBED) -> list[int]:
    """The cells a query looks into: those of the nearest centroids."""
    if not len(centres) or len(query) != centres.shape[1]:
        return []
    order = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")
    return [int(i) for i in order[: _looked(len(centres), share)]]


def search_cells(stored: DataFrame, centroids: DataFrame, query: Sequence[float], top_k: int = TOP_K, threshold: float = 0.0, share: float = PROBED) -> DataFrame:
    """(chunk_id, score): approximate search in rows stored by cell (cell, chunk_id, embedding). The cells become a filter
    that reaches the scan; rows in other cells are not looked at, nor scored."""
    asked = probes(_centres(centroids), query, share)
    return search_vector(stored.where(F.col("cell").isin(asked) if asked else F.lit(False)), query, top_k, threshold)


#: Elements of the rows, and of the queries, that a task holds at once in a batch search; queries and rows that are
#: multiplied at once, and pairs that are scored at once.
TILE_VALUES, STEP_QUERIES, STEP_ROWS, STEP_PAIRS = 1 << 22, 512, 2048, 16_384


def _tiles(sizes: Sequence[int], most: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The cells (from, to) of each tile, as many as hold ``most`` rows; each cell's first tile and how many it has: a
    cell with more rows is cut into tiles of its own."""
    spans: list[tuple[int, int]] = []
    first, own, free = [], [], -1
    for cell, n in enumerate(sizes):
        tiles = max(1, math.ceil(n / most))
        if tiles == 1 and n <= free:
            spans[-1], free = (spans[-1][0], cell + 1), free - n
        else:
            spans += [(cell, cell + 1)] * tiles
            free = most - n if tiles == 1 else -1
        first.append(len(spans) - tiles)
        own.append(tiles)
    return spans, first, own


def _may_be_best(v: np.ndarray, ids: np.ndarray, cells: np.ndarray, top_k: int) -> np.ndarray:
    """The rows, in order, without those that ``top_k`` equal vectors of their cell with lower ids go before."""
    kinds = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, cells, kinds))
    own = np.flatnonzero(np.r_[True, (np.diff(kinds[order]) != 0) | (np.diff(cells[order]) != 0)][: len(order)])
    rank = np.arange(len(order)) - np.repeat(own, np.diff(np.r_[own, len(order)]))
    return np.sort(order[rank < top_k])


def _pair_scores(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of unit rows i of ``q`` and j of ``v``, to the last bit the same in whatever company a pair is scored."""
    parts = [(q[i[at : at + STEP_PAIRS]] * v[j[at : at + STEP_PAIRS]]).sum(axis=1) + 0.0 for at in range(0, len(i), STEP_PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _best_of_tile(q: np.ndarray, v: np.ndarray, ids: np.ndarray, ends: np.ndarray, probed: np.ndarray, top_k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of each query's best rows in the cells it looks into; ties go by id.

    Cell c has the rows ends[c] to ends[c + 1]. Products in single precision rule rows out, by more than their error; what
    remains is scored in double precision.
    """
    slack = (q.shape[1] + 8) * 2.0**-23
    q32, v32 = q.astype(np.float32), v.astype(np.float32)
    for start in range(0, len(q), STEP_QUERIES):
        looks = probed[start : start + STEP_QUERIES]
        least = np.full(len(looks), -np.inf, np.float32)
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        found, waiting = [none], 0

        def merged(found: list, least: np.ndarray = least) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            who, row, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((ids[row], -score, who))
            who, row, score = who[order], row[order], score[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == top_k - 1
            least[who[last]] = np.maximum(least[who[last]], score[last] - slack)
            return who[rank < top_k], row[rank < top_k], score[rank < top_k]

        for cell in range(looks.shape[1]):
            asking = np.flatnonzero(looks[:, cell])
            for lo in range(ends[cell], ends[cell + 1] if len(asking) else 0, STEP_ROWS):
                hi = min(lo + STEP_ROWS, ends[cell + 1])
                s = q32[start + asking] @ v32[lo:hi].T
                if hi - lo > top_k and len(new := np.flatnonzero(np.isneginf(least[asking]))):
                    least[asking[new]] = np.partition(s[new], hi - lo - top_k, axis=1)[:, hi - lo - top_k] - 2 * slack
                i, j = np.divmod(np.flatnonzero(s >= least[asking][:, None]), hi - lo)
                i, j = asking[i], lo + j
                found.append((i, j, _pair_scores(q[start : start + STEP_QUERIES], v, i, j)))
                waiting += len(i)
                if waiting > top_k * len(looks):
                    found, waiting = [merged(found)], 0
        who, row, score = merged(found)
        yield start + who, ids[row], score


def search_cells_batch(stored: DataFrame, centroids: DataFrame, queries: DataFrame, top_k: int = TOP_K, share: float = PROBED) -> DataFrame:
    """(query_id, chunk_id, score): approximate search for any number of queries (query_id, embedding); exact, over all
    rows that are in a cell, with a ``share`` of 1.

    Queries and stored rows meet by tile: some cells, or a part of a large one, and as many queries as a task holds. Each
    tile gives a query's best in the cells it looks into, and a partial top-k merges them. A query is sent once to a tile,
    a row once for every part of the queries. Nothing but the centroids is broadcast. Equal vectors have equal scores in
    every tile and at every share, so ties go by id.
    """
    shape = "query_id bigint, chunk_id bigint, score double"
    centres = _centres(centroids)
    count, dim = centres.shape
    held = stored.where(F.col("cell").between(0, count - 1) & F.col("chunk_id").isNotNull()).select("cell", "chunk_id", "embedding")
    sizes = dict(held.groupBy("cell").count().collect())
    if not sizes or top_k < 1:
        return stored.sparkSession.createDataFrame([], shape)
    most = max(STEP_ROWS, TILE_VALUES // dim)
    spans, first, own = _tiles([sizes.get(c, 0) for c in range(count)], most)
    parts = max(1, math.ceil(queries.count() / most))
    looked = _looked(count, share)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, fits = _matrix(b.column(1), dim)
            for at in range(0, len(q), STEP_QUERIES):
                near = np.argsort(-(q[at : at + STEP_QUERIES] @ centres.T), axis=1, kind="stable")[:, :looked]
                probed = np.zeros((len(near), count), bool)
                np.put_along_axis(probed, near, True, axis=1)
                for tile, (lo, hi) in enumerate(spans):
                    here = np.flatnonzero(probed[:, lo:hi].any(axis=1))
                    rows = pa.array(fits[at + here])
                    bits = [x.tobytes() for x in np.packbits(probed[here, lo:hi], axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), tile, np.int32)), b.column(0).take(rows), b.column(1).take(rows), pa.array(bits, pa.binary())], names=["tile", "query_id", "embedding", "cells"])

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(parts)).cast("int").alias("part")

    asked = queries.where("query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    asked = asked.mapInArrow(sent, "tile int, query_id bigint, embedding array<float>, cells binary").select("*", part("query_id"))
    of_cell = [F.expr(f"element_at(array({','.join(map(str, x))}), cell + 1)") for x in (first, own)]
    held = held.withColumn("tile", (of_cell[0] + F.pmod(F.xxhash64("chunk_id"), of_cell[1])).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def compare(key: tuple[pa.Scalar, ...], one: pa.Table, other: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        if not one.num_rows or not other.num_rows:
            return schema.empty_table()
        lo, hi = spans[key[0].as_py()]
        q, which = _matrix(one.column("embedding").combine_chunks(), dim)
        bits = np.frombuffer(b"".join(one.column("cells").to_pylist()), np.uint8).reshape(one.num_rows, -1)
        probed = np.unpackbits(bits, axis=1, count=hi - lo)[which].astype(bool)
        names = one.column("query_id").to_numpy()[which]
        other = other.sort_by("cell")
        v, at = _matrix(other.column("embedding").combine_chunks(), dim)
        ids, cells = other.column("chunk_id").to_numpy()[at], other.column("cell").to_numpy()[at]
        keep = _may_be_best(v, ids, cells, top_k)
        ends = np.searchsorted(cells[keep], np.arange(lo, hi + 1))
        found = [(names[i], best, s) for i, best, s in _best_of_tile(q, v[keep], ids[keep], ends, probed, top_k)]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema) if found else schema.empty_table()

    met = asked.groupBy("tile", "part").cogroup(held.groupBy("tile", "part")).applyInArrow(compare, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k).drop("r")


def search(vectors: DataFrame, query: Sequence[float], top_k: int = TOP_K, threshold: float = 0.0, method: str = "exact", id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """Exact search by default; ``method="cells"`` trades recall for looking at fewer rows. An index keeps the cells; for
    other vectors they are made here, which pays off for many queries only."""
    if method == "exact":
        return search_vector(vectors, query, top_k, threshold, id_column=id_column, vector_column=vector_column)
    if method != "cells":
        raise ValueError(f"no such method: {method}")
    centroids = fit_cells(vectors, id_column=id_column, vector_column=vector_column)
    return search_cells(in_cells(vectors, centroids, id_column, vector_column), centroids, query, top_k, threshold)


def search_vectors(vectors: DataFrame, queries: DataFrame, top_k: int = TOP_K, block: int = 2048, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score): exact search for a stated set of queries against all rows, in blocks.

    ``queries`` (query_id, embedding), MOST_QUERIES at most, goes to the executors in blocks of a fixed size; every task
    keeps the best of a block for what it read, and a partial top-k aggregation merges them. More queries are an error: ask
    in parts, or search approximately.
    """
    asked = queries.select("query_id", "embedding").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once")
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where("id is not null and v is not null and size(v) > 0")
    out = None
    for start in range(0, len(asked), block):
        part = asked[start : start + block]
        names = np.array([r.query_id for r in part], np.int64)
        q = np.array([r.embedding for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best_s = np.full((len(names), 0), -2.0)
            best_i = np.zeros((len(names), 0), np.int64)
            for b in batches:
                sizes = np.diff(b.column(1).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
                fits = np.flatnonzero(sizes == q.shape[1])
                if not len(fits):
                    continue
                v = b.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                s = q @ np.divide(v, length, out=np.zeros_like(v), where=length > 0).T
                s = np.concatenate([best_s, np.nan_to_num(s, nan=-2.0)], axis=1)
                i = np.concatenate([best_i, np.tile(b.column(0).to_numpy()[fits], (len(names), 1))], axis=1)
                keep = np.lexsort((i, -s), axis=1)[:, :top_k]
                best_s, best_i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            if best_s.shape[1]:
                width = best_s.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["query_id", "chunk_id", "score"])

        rows = source.mapInArrow(run, "query_id bigint, chunk_id bigint, score double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return source.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k).drop("r")
