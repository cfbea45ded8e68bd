r"""Most similar vectors for every vector: NN-descent on Spark joins, and greedy search of the graph it builds.

Copies of a vector are one class, and vectors are held as byte codes (one signed byte an element), equal codes as one
node. A first graph comes from trees of random hyperplanes: per tree every node gets a code of signs, all nodes are range
partitioned by tree and code, and runs of ``block`` neighbours in that order are compared with one another. Runs have a
fixed length, so no bucket is ever too large, whatever the vectors are. Rounds of NN-descent follow: every node sends its
vector to the nodes it is linked with (one join), each node compares what it got (neighbours of neighbours), and better
links replace worse ones (one aggregation), until few change. A node in many lists keeps the best of them in every task
before any shuffle. Reported similarities are computed from the vectors themselves.

A node keeps ``keep`` links, so a node with more partners than that is full of them. A pair with a node that is not full
is among that node's links; pairs of two full nodes come from an exact join of the full nodes alone, in stripes of a fixed
size whose blocks are skipped where the triangle inequality of angles rules a pair out. So the cut of lists loses no pair.

Cases: a null embedding, another length than ``dim``, a null, NaN or infinite element or only zeros make a row unusable;
a repeated row counts once, of different vectors of one id the smallest holds; vectors of any length are compared by
angle; ties are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondage.storage import written

#: Bits of a sign code.
BITS = 40
#: Nodes of a stripe and of a block of it in the exact join; links gathered by a task before the best of a node are cut.
STRIPE, PIECE, GATHERED = 16_384, 1024, 1_000_000


@dataclass(frozen=True)
class Shape:
    """How a graph is built: trees of the first graph, rows of a run, links a tree proposes, links a node keeps, links of
    each direction a node is compared over in a round, most rounds, and the changed share of links that ends them."""

    trees: int = 10
    block: int = 1024
    propose: int = 4
    keep: int = 8
    spread: int = 5
    rounds: int = 2
    settled: float = 0.002


#: For pairs of high similarity, and for neighbours at any similarity.
PAIRS, SEARCH = Shape(), Shape(trees=12, propose=8, keep=20, spread=10, rounds=4, settled=0.01)
_LINK = np.dtype([("id", "<i8"), ("sim", "<f4")])
SEED = 20_240


def usable(vectors: DataFrame, id_column: str = "chunk_id", vector_column: str = "embedding", dim: int = 64) -> DataFrame:
    """(id, embedding): usable rows, one per id."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<float>").alias("embedding"))
    return rows.where(F.col("id").isNotNull() & (F.size(v) == dim) & fine).groupBy("id").agg(F.min("embedding").alias("embedding"))


def _codes(matrix: np.ndarray) -> np.ndarray:
    top = np.abs(matrix).max(axis=1, keepdims=True)
    return np.rint(matrix / top * 127).astype(np.int8)


def _unit(codes: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def code_floor(least: float, dim: int) -> float:
    """The similarity of codes that no pair of a true similarity of ``least`` stays under.

    Rounding moves an element by half a step of 127, so it turns a vector by no more than asin(sqrt(dim) / 254).
    """
    turn = math.asin(min(1.0, math.sqrt(dim) / 254))
    return math.cos(min(math.pi, math.acos(max(-1.0, min(1.0, least))) + 2 * turn)) - 1e-5


def coded(rows: DataFrame) -> DataFrame:
    """(id, embedding, q, h): the byte code of every vector, and a digest that copies of a vector share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + np.float32(0)
                q = [r.tobytes() for r in _codes(flat.astype(np.float64))]
                h = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in flat]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q, pa.binary()), pa.array(h, pa.binary())], names=["id", "embedding", "q", "h"])

    return rows.select("id", "embedding").mapInArrow(run, "id bigint, embedding array<float>, q binary, h binary")


def _in_trees(nodes: DataFrame, trees: int, dim: int) -> DataFrame:
    """(tree, code, id, q): the sign code of every node in every tree; the planes are fixed by the seed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((trees * BITS, dim)).astype(np.float32)
        weights = (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))[:, None]
        for b in batches:
            if not b.num_rows:
                continue
            signs = (_unit(b.column(1).to_pylist()) @ planes.T > 0).reshape(b.num_rows, trees, BITS)
            codes = (signs.astype(np.int64) @ weights)[:, :, 0]
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(codes[:, t]), b.column(0), b.column(1)], names=["tree", "code", "id", "q"])

    return nodes.select("id", "q").mapInArrow(run, "tree int, code bigint, id bigint, q binary")


def _best(sims: np.ndarray, most: int) -> np.ndarray:
    most = min(most, sims.shape[1])
    return np.argpartition(sims, sims.shape[1] - most, axis=1)[:, -most:]


def _compare_runs(shape: Shape, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (tree, code) order: the best links inside each run of rows, packed per node."""

    block = shape.block

    def links(ids: np.ndarray, q: list[bytes]) -> pa.RecordBatch:
        unit = _unit(q)
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2)
        best = _best(sims, shape.propose)
        out = np.empty(best.shape, _LINK)
        out["id"], out["sim"] = ids[best], np.take_along_axis(sims, best, 1)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in out], pa.binary())], names=["id", "links"])

    trees, ids, q = np.empty(0, np.int32), np.empty(0, np.int64), []
    for b in batches:
        trees, ids = np.concatenate([trees, b.column(0).to_numpy()]), np.concatenate([ids, b.column(2).to_numpy()])
        q += b.column(3).to_pylist()
        while len(ids) >= 2 * block:
            cut = block if trees[0] == trees[block - 1] else int(np.searchsorted(trees, trees[0], "right"))
            if cut > 1:
                yield links(ids[:cut], q[:cut])
            trees, ids, q = trees[cut:], ids[cut:], q[cut:]
    while len(ids):
        cut = int(np.searchsorted(trees, trees[0], "right"))
        cut = cut if cut <= 1.5 * block else block
        if cut > 1:
            yield links(ids[:cut], q[:cut])
        trees, ids, q = trees[cut:], ids[cut:], q[cut:]


def _runs_of(ids: np.ndarray) -> np.ndarray:
    """Where runs of equal ids start, and the end of the last."""
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)


def _by_node(batches: Iterator[pa.RecordBatch], column: int = 0, at_least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ids, from rows sorted by id."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < at_least:
            continue
        t = pa.Table.from_batches(held)
        ids = t.column(column).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1], "left"))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _merge(keep_best: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, q, links, fresh) sorted by id: one row per id with its q and its best links, how many are new, and the
    similarity of the last one of a full list."""
    for t in _by_node(batches):
        ids = t.column(0).to_numpy()
        q, packed = t.column(1).to_pylist(), t.column(2).to_pylist()
        old = t.column(3).to_numpy()
        sizes = np.array([len(x) // _LINK.itemsize if x else 0 for x in packed])
        flat = np.frombuffer(b"".join(x for x in packed if x), _LINK)
        node, new = np.repeat(ids, sizes), np.repeat(old != 0, sizes)
        order = np.lexsort((new, -flat["sim"], flat["id"], node))
        node, link, new = node[order], flat[order], new[order]
        keep = np.ones(len(node), bool)
        keep[1:] = (node[1:] != node[:-1]) | (link["id"][1:] != link["id"][:-1])
        keep &= node != link["id"]
        node, link, new = node[keep], link[keep], new[keep]
        order = np.lexsort((link["id"], -link["sim"], node))
        node, link, new = node[order], link[order], new[order]
        starts = _runs_of(node)
        rank = np.arange(len(node)) - np.repeat(starts[:-1], np.diff(starts)) if len(node) else np.empty(0, int)
        node, link, new = node[rank < keep_best], link[rank < keep_best], new[rank < keep_best]
        where = {i: x for i, x in zip(ids.tolist(), q) if x is not None}
        out_ids = np.array(sorted(where), np.int64)
        a, z = np.searchsorted(node, out_ids, "left"), np.searchsorted(node, out_ids, "right")
        sums = np.concatenate([[0], np.cumsum(new)])
        worst = np.full(len(out_ids), -2, np.float32)
        full = z - a == keep_best
        worst[full] = link["sim"][z[full] - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_ids), pa.array([where[i] for i in out_ids.tolist()], pa.binary()), pa.array([link[x:y].tobytes() for x, y in zip(a, z)], pa.binary()), pa.array((sums[z] - sums[a]).astype(np.int32)), pa.array(worst)],
            names=["id", "q", "links", "fresh", "worst"],
        )


_GRAPH = "id bigint, q binary, links binary, fresh int, worst float"


def _merged(nodes: DataFrame, proposals: DataFrame, old: bool, shape: Shape) -> DataFrame:
    mine = nodes.select("id", "q", F.col("links") if old else F.lit(None).cast("binary").alias("links"), F.lit(0).alias("fresh"))
    both = mine.unionByName(proposals.select("id", F.lit(None).cast("binary").alias("q"), "links", F.lit(1).alias("fresh")))
    return both.repartition("id").sortWithinPartitions("id").mapInArrow(partial(_merge, shape.keep), _GRAPH)


def _best_members(most: int, node: np.ndarray, member: np.ndarray, sim: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """Of every node the ``most`` best members, each once; new if any of its rows is."""
    order = np.lexsort((~new, member, -sim, node))
    node, member, sim, new = node[order], member[order], sim[order], new[order]
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (member[1:] != member[:-1])
    node, member, sim, new = node[keep], member[keep], sim[keep], new[keep]
    starts = _runs_of(node)
    rank = np.arange(len(node)) - np.repeat(starts[:-1], np.diff(starts)) if len(node) else np.empty(0, int)
    top = rank < most
    return pa.RecordBatch.from_arrays([pa.array(node[top]), pa.array(member[top]), pa.array(sim[top]), pa.array(new[top])], names=["node", "member", "sim", "new"])


_MEMBER = "node bigint, member bigint, sim float, new boolean"


def _links_both_ways(spread: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, member, sim, new) for the ``spread`` best links of each node, in both directions.

    A node that many others link to keeps its best members among what the task gathered, so its rows do not grow with
    the number of those others.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        ids, packed, fresh = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
        cut = [x[: spread * _LINK.itemsize] for x in packed]
        to = np.frombuffer(b"".join(cut), _LINK)
        lengths = [len(x) // _LINK.itemsize for x in cut]
        of, new = np.repeat(ids, lengths), np.repeat(fresh > 0, lengths)
        held.append((np.concatenate([of, to["id"]]), np.concatenate([to["id"], of]), np.concatenate([to["sim"]] * 2), np.concatenate([new] * 2)))
        size += 2 * len(of)
        if size >= GATHERED:
            yield _best_members(2 * spread, *(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield _best_members(2 * spread, *(np.concatenate(x) for x in zip(*held)))


def _cut_members(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over all tasks, of rows sorted by node; nodes whose links are all known to each other fall away."""
    for t in _by_node(batches):
        best = _best_members(most, *(t.column(i).to_numpy() for i in range(4)))
        starts = _runs_of(best.column(0).to_numpy())
        lengths = np.diff(starts)
        if len(lengths):
            some = np.add.reduceat(best.column(3).to_numpy(zero_copy_only=False).astype(int), starts[:-1]) > 0
            yield best.filter(pa.array(np.repeat(some & (lengths > 1), lengths)))


def _compare_members(keep_best: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, member, q, worst) sorted by node: links between members that beat a member's worst, its best ones."""
    for t in _by_node(batches):
        node, member = t.column(0).to_numpy(), t.column(1).to_numpy()
        unit, worst = _unit(t.column(2).to_pylist()), t.column(3).to_numpy()
        starts = _runs_of(node)
        lengths = np.diff(starts)
        found = []
        for size in np.unique(lengths):
            if size < 2:
                continue
            rows = starts[:-1][lengths == size][:, None] + np.arange(size)
            v, m = unit[rows], member[rows]
            sims = v @ v.transpose(0, 2, 1)
            better = (sims > worst[rows][:, :, None]) & (m[:, :, None] != m[:, None, :])
            g, i, j = np.nonzero(better)
            found.append((m[g, i], m[g, j], sims[g, i, j]))
        if not found:
            continue
        a, b, s = (np.concatenate(x) for x in zip(*found))
        best = _best_members(keep_best, a, b, s, np.ones(len(a), bool))
        a, link = best.column(0).to_numpy(), np.empty(best.num_rows, _LINK)
        link["id"], link["sim"] = best.column(1).to_numpy(), best.column(2).to_numpy()
        at = _runs_of(a)
        yield pa.RecordBatch.from_arrays([pa.array(a[at[:-1]] if len(a) else a), pa.array([link[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["id", "links"])


def descend(graph: DataFrame, shape: Shape = PAIRS) -> DataFrame:
    """One round of NN-descent: ids and similarities are shuffled to choose members, then the vectors of those chosen go
    to the nodes that have a new link, and the links kept come back."""
    both = graph.select("id", "links", "fresh").mapInArrow(partial(_links_both_ways, shape.spread), _MEMBER)
    chosen = both.repartition("node").sortWithinPartitions("node").mapInArrow(partial(_cut_members, 2 * shape.spread), _MEMBER)
    vectors = graph.select(F.col("id").alias("member"), "q", "worst")
    sent = chosen.select("node", "member").join(vectors, "member").select("node", "member", "q", "worst")
    ordered = sent.repartition("node").sortWithinPartitions("node", "member")
    return _merged(graph, ordered.mapInArrow(partial(_compare_members, shape.keep), "id bigint, links binary"), old=True, shape=shape)


@dataclass(frozen=True)
class Graph:
    """``rows`` (id, embedding, q, h), ``members`` (id, class), ``classes`` (class, node), the ``nodes`` (id, q, links,
    fresh, worst)."""

    rows: DataFrame
    members: DataFrame
    classes: DataFrame
    nodes: DataFrame


def build_graph(vectors: DataFrame, shape: Shape = PAIRS, id_column: str = "chunk_id", vector_column: str = "embedding", dim: int = 64) -> Graph:
    """The graph of all usable rows. Copies meet in partial aggregates, so a third of all rows may be one vector."""
    rows = written(coded(usable(vectors, id_column, vector_column, dim)), "vectors")
    copies = written(rows.groupBy("h").agg(F.min("id").alias("class"), F.min("q").alias("q")), "copies")
    nodes = written(copies.groupBy("q").agg(F.min("class").alias("id")).select("id", "q"), "nodes")
    classes = copies.select("class", "q").join(nodes.withColumnRenamed("id", "node"), "q").select("class", "node")
    members = rows.select("id", "h").join(copies.select("h", "class"), "h").select("id", "class")
    in_trees = _in_trees(nodes, shape.trees, dim).repartitionByRange("tree", "code", "id").sortWithinPartitions("tree", "code", "id")
    graph = written(_merged(nodes, in_trees.mapInArrow(partial(_compare_runs, shape), "id bigint, links binary"), old=False, shape=shape), "graph")
    for _ in range(shape.rounds):
        graph = written(descend(graph, shape), "graph")
        state = graph.agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("n")).first()
        if (state.fresh or 0) <= shape.settled * shape.keep * (state.n or 0):
            break
    return Graph(rows, written(members, "members"), written(classes, "classes"), graph)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = b.column(1).to_pylist()
        to = np.frombuffer(b"".join(packed), _LINK)
        of = np.repeat(b.column(0).to_numpy(), [len(x) // _LINK.itemsize for x in packed])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.ascontiguousarray(to["id"])), pa.array(np.ascontiguousarray(to["sim"]))], names=["id", "other", "sim"])


def edges(graph: DataFrame) -> DataFrame:
    """(id, other, sim): the links as rows; sim is that of the codes, which ``code_floor`` bounds."""
    return graph.select("id", "links").mapInArrow(_unpack, "id bigint, other bigint, sim float")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, in double."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact cosine."""
    left = rows.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = rows.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def _balls(unit: np.ndarray) -> list[tuple[int, int, np.ndarray, float]]:
    """Pieces of rows: start, end, centre and the widest angle to it."""
    out = []
    for a in range(0, len(unit), PIECE):
        part = unit[a : a + PIECE]
        centre = part.mean(axis=0)
        centre /= max(float(np.linalg.norm(centre)), 1e-12)
        out.append((a, a + len(part), centre, float(np.arccos(np.clip((part @ centre).min(), -1, 1)))))
    return out


def _join_cells(floor: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, stripe, id, q) sorted by cell and stripe: the pairs (x, y), x < y, of a cell's two stripes."""
    widest = math.acos(floor) + 1e-3
    for t in _by_node(batches, at_least=1):
        cells = t.column(0).to_numpy()
        for a, z in zip(_runs_of(cells)[:-1], _runs_of(cells)[1:]):
            part = t.slice(a, z - a)
            stripe, ids, unit = part.column(1).to_numpy(), part.column(2).to_numpy(), _unit(part.column(3).to_pylist())
            cut = int(np.searchsorted(stripe, stripe[0], "right"))
            one = _balls(unit[:cut])
            other = [(s + cut, e + cut, c, r) for s, e, c, r in _balls(unit[cut:])] if cut < len(ids) else one
            for a1, z1, c1, r1 in one:
                for a2, z2, c2, r2 in other:
                    if cut == len(ids) and a2 < a1 or math.acos(max(-1.0, min(1.0, float(c1 @ c2)))) > r1 + r2 + widest:
                        continue
                    i, j = np.nonzero(unit[a1:z1] @ unit[a2:z2].T >= floor)
                    x, y = ids[a1:z1][i], ids[a2:z2][j]
                    once = x < y if a1 == a2 else x != y
                    x, y = x[once], y[once]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])


def full_pairs(graph: DataFrame, floor: float, dim: int = 64, stripe: int = STRIPE) -> DataFrame:
    """(x, y), x < y: all pairs of full nodes with a similarity of codes of ``floor`` or more; exact.

    Full nodes, sorted by their sign codes, are cut into stripes; every pair of stripes is a cell of its own. The cost is
    that of the full nodes alone, and balls that are too far apart are skipped.
    """
    full = graph.where(F.col("worst") >= floor).select("id", "q")
    if not (n := full.count()):
        return graph.select(F.col("id").alias("x"), F.col("id").alias("y")).limit(0)
    stripes = -(-n // stripe)
    placed = _in_trees(full, 1, dim).repartitionByRange(stripes, "code", "id").select(F.spark_partition_id().alias("stripe"), "code", "id", "q")
    placed = written(placed, "stripes")
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    cell = F.least("stripe", "other").cast("bigint") * stripes + F.greatest("stripe", "other")
    sent = sent.select(cell.alias("cell"), "stripe", "id", "q", "code").repartition("cell").sortWithinPartitions("cell", "stripe", "code", "id")
    return sent.select("cell", "stripe", "id", "q").mapInArrow(partial(_join_cells, floor), "x bigint, y bigint")


def similar_classes(vectors: DataFrame, least: float = 0.90, id_column: str = "chunk_id", vector_column: str = "embedding", dim: int = 64, shape: Shape = PAIRS) -> tuple[DataFrame, DataFrame]:
    """Pairs (class_a, class_b, cosine) of classes of copies with an exact cosine of ``least`` or more, and the members
    (id, class) of the classes. A class is named by its smallest id; copies are not expanded into pairs."""
    graph = build_graph(vectors, shape, id_column, vector_column, dim)
    floor = code_floor(least, dim)
    linked = edges(graph.nodes).where(F.col("sim") >= floor).select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y"))
    near = linked.unionByName(full_pairs(graph.nodes, floor, dim)).distinct()
    one, two = graph.classes.select(F.col("class").alias("p"), F.col("node").alias("x")), graph.classes.select(F.col("class").alias("q"), F.col("node").alias("y"))
    across = near.join(one, "x").join(two, "y").select("p", "q")
    shared = graph.classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("x"))
    inside = one.join(shared, "x", "left_semi").join(two.withColumnRenamed("y", "x"), "x").where("p < q").select("p", "q")
    pairs = across.unionByName(inside).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    scored = _scored(pairs, graph.rows).where(F.col("cosine") >= least)
    return scored.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "cosine"), graph.members


def expanded_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: the pairs of classes as pairs of their members, and the pairs of copies."""
    one, two = members.select(F.col("id").alias("p"), F.col("class").alias("class_a")), members.select(F.col("id").alias("q"), F.col("class").alias("class_b"))
    across = pairs.join(one, "class_a").join(two, "class_b").select("p", "q")
    copies = members.where("id != class").select("class").distinct().withColumnRenamed("class", "class_a")
    inside = one.join(copies, "class_a", "left_semi").join(two.withColumnRenamed("class_b", "class_a"), "class_a").where("p < q").select("p", "q")
    return across.unionByName(inside).select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b"))


def class_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, links): every row with its class and with how many others it is similar to, its copies included."""
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("class_a").alias("class"), F.col("class_b").alias("to")).unionByName(pairs.select(F.col("class_b").alias("class"), F.col("class_a").alias("to")))
    links = both.join(sizes.select(F.col("class").alias("to"), "size"), "to").groupBy("class").agg(F.sum("size").alias("others"))
    per_class = sizes.join(links, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(per_class, "class").select("id", "class", "links")


def similar_pairs(vectors: DataFrame, least: float = 0.90, id_column: str = "chunk_id", vector_column: str = "embedding", dim: int = 64, shape: Shape = PAIRS) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: all pairs of rows with a cosine of ``least`` or more."""
    return expanded_pairs(*similar_classes(vectors, least, id_column, vector_column, dim, shape))


def _sims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, node, sim) of rows (query, node, code of the query, code of the node)."""
    for b in batches:
        if b.num_rows:
            sims = np.einsum("ij,ij->i", _unit(b.column(2).to_pylist()), _unit(b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims)], names=["query", "node", "sim"])


def greedy_search(graph: DataFrame, queries: DataFrame, beam: int = 48, hops: int = 3) -> DataFrame:
    """(query, node, sim): the ``beam`` best nodes found for queries (query, q), by walking the graph.

    Every hop opens the nodes of the beam that were not opened yet, all queries at once: one join with the links, one with
    the codes, and a top-k per query, of which each task sends on no more than the beam.
    """
    links = edges(graph).select(F.col("id").alias("node"), "other")
    codes = graph.select(F.col("id").alias("node"), F.col("q").alias("code"))
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(codes, "node").join(queries, "query").select("query", "node", "q", "code")
        return rows.mapInArrow(_sims, "query bigint, node bigint, sim float")

    start = queries.select("query", F.col("query").alias("node")).join(graph.select(F.col("id").alias("node")), "node", "left_semi")
    found = written(scored(start).withColumn("opened", F.lit(False)), "beam")
    for _ in range(hops + 1):
        ahead = found.where("not opened").join(links, "node").select("query", F.col("other").alias("node")).distinct()
        fresh = scored(ahead.join(found.select("query", "node"), ["query", "node"], "left_anti")).withColumn("opened", F.lit(False))
        both = found.withColumn("opened", F.lit(True)).unionByName(fresh)
        found = written(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), "beam")
    return found.select("query", "node", "sim")


def neighbours(vectors: DataFrame, k: int = 5, every: int = 1, shape: Shape = SEARCH, id_column: str = "chunk_id", vector_column: str = "embedding", dim: int = 64) -> DataFrame:
    """(chunk_id, other, cosine): the k most similar others of every row, or of rows whose id is divisible by ``every``.

    The graph holds all rows. Of each class the ``k + 1`` smallest ids take part after the walk, since copies tie and ties
    go by id; all that the walk found is scored from the vectors before the cut to ``k``.
    """
    graph = build_graph(vectors, shape, id_column, vector_column, dim)
    asked = written(graph.members.where(F.col("id") % every == 0).join(graph.classes, "class").select("id", "class", "node"), "asked")
    queries = graph.nodes.join(asked.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), "q")
    near = greedy_search(graph.nodes, written(queries, "queries"))
    first = graph.members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    heads = asked.select(F.col("class").alias("a"), F.col("node").alias("query")).distinct()
    pairs = heads.join(near.select("query", "node"), "query").join(graph.classes.select(F.col("class").alias("b"), "node"), "node").select("a", "b")
    scored = _scored(pairs, graph.rows)
    found = asked.select(F.col("id").alias("chunk_id"), F.col("class").alias("a")).join(scored, "a").join(first.select(F.col("id").alias("other"), F.col("class").alias("b")), "b").where("chunk_id != other")
    last = Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).select("chunk_id", "other", F.round("cosine", 6).alias("cosine"))
