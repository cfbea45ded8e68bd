r"""Mixing sources to target weights, with soft membership for documents whose source is unknown.

Source names are brought to one spelling. A classifier fitted on labelled rows gives each document without a source a
posterior over the sources; a labelled document belongs to its source alone. Targets too large for what their source can
give within its repeats are cut to that, and the others grow in proportion, as far as they can. Projected-gradient least
squares then fits a rate of copies to every document so that the expected tokens of the sources meet those targets. It
starts on sums over groups of like memberships, at most LEVELS^2 for each pair of sources whatever the input, and ends
with steps over all rows, each one distributed sum of as many numbers as there are sources. Rates become whole copies by a hash of the id,
with a threshold per source found in a histogram, so the collection meets its totals to about a document.

Cases: spellings of a name that differ in case, blanks or punctuation are one source; a source without target is left
out; a target without documents stays at 0; null or empty texts have no tokens and are left out; a repeated doc_id counts
once, of different texts of one id always the same; with no targets or documents the result is empty; with no labelled document the posterior is the targets' shares.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.corpus_encoding import NAME, TOKENIZERS, count_tokens
from sondage.functions.lexers import extension
from sondage.storage import written

#: Bound of the labelled rows the classifier is fitted on, and its hashed features.
SAMPLE, WIDTH = 6000, 1024
#: Most steps of the fit, and the largest miss of a share, or change of it, that ends it.
STEPS, MISS = 200, 1e-5
#: Steps over all rows after those over the group sums, and levels of a membership's two largest shares in a group.
FINE_STEPS, LEVELS = 6, 16
#: Buckets of the hash histogram, at each of two levels.
BUCKETS = 4096
_TERM = re.compile(r"[^\W\d_]+")


def source_name(column: Column) -> Column:
    """One spelling of a source's name; null for a blank one."""
    name = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " ")
    name = F.regexp_replace(F.trim(name), " ", "_")
    return F.when(name != "", name)


def _features(texts: list[str | None], hints: list[list[str | None]]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    memo: dict[str, int] = {}
    for row, (text, more) in enumerate(zip(texts, hints)):
        for term in set(_TERM.findall((text or "").lower())) | {f"\x00{k}{v}" for k, v in enumerate(more) if v}:
            at = memo.get(term)
            if at is None:
                at = memo[term] = zlib.crc32(term.encode("utf-8", "surrogatepass")) % WIDTH
            out[row, at] += 1.0
    out = np.log1p(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(texts: list[str | None], hints: list[list[str | None]], labels: np.ndarray, classes: int, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression by Adam; rows are at most SAMPLE."""
    x, y = _features(texts, hints), np.eye(classes, dtype=np.float32)[labels]
    w = np.zeros((WIDTH, classes), np.float32)
    b = np.log((y.sum(0) + 0.5) / (len(y) + 0.5 * classes)).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = x.T @ (_softmax(x @ w + b) - y) / max(len(y), 1) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w, b


_HINTS = ("lang", "project", "file_path")


def _hint_columns(documents: DataFrame) -> list[Column]:
    return [F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string") for c in _HINTS]


def _hints_of(rows: list[list[str | None]]) -> list[list[str | None]]:
    return [[lang and lang.lower(), project, extension(path)] for lang, project, path in rows]


def _bounded_sample(rows: DataFrame):
    """At most SAMPLE rows, the same whatever the partitions: a cut of the id's hash leaves few more than needed, so that
    the tasks together send the driver no more than that."""
    n = rows.count()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    cut = int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 40))
    return rows.where(hashed < cut).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toPandas()


def posteriors(documents: DataFrame, names: list[str], prior: list[float]) -> DataFrame:
    """(doc_id, h, posterior) of the documents without a source; ``h`` tells texts of one id apart."""
    label = source_name(F.col("source"))
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), *[c.alias(f"h{i}") for i, c in enumerate(_hint_columns(documents))], F.xxhash64("text").alias("h")]
    known = documents.where(label.isin(names) & F.col("text").isNotNull())
    sample = _bounded_sample(known.select(*columns, label.alias("label"))) if names else None
    if sample is None or sample.empty:
        model = None
    else:
        hints = _hints_of(sample[["h0", "h1", "h2"]].astype(object).where(sample[["h0", "h1", "h2"]].notna(), None).values.tolist())
        at = {n: i for i, n in enumerate(names)}
        model = fit_classifier(sample["text"].tolist(), hints, sample["label"].map(at).to_numpy(), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [list(r) for r in zip(*(b.column(2 + i).to_pylist() for i in range(3)))]
            if model is None:
                p = np.tile(np.array(prior), (b.num_rows, 1))
            else:
                p = _softmax(_features(b.column(1).to_pylist(), _hints_of(rows)) @ model[0] + model[1]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "h", "posterior"])

    found = documents.where(label.isNull() & F.col("text").isNotNull()).select(*columns).mapInArrow(run, "doc_id bigint, h bigint, posterior array<double>")
    return found.groupBy("doc_id", "h").agg(F.min("posterior").alias("posterior"))


def fill_targets(shares: np.ndarray, capacity: np.ndarray, total: float) -> np.ndarray:
    """Tokens per source: target shares of ``total``; what a source cannot give goes to the others in proportion."""
    given, open_ = np.zeros_like(shares), shares > 0
    left = min(total, capacity[open_].sum())
    while left > 1e-9 * max(total, 1) and open_.any():
        want = shares * open_ / (shares * open_).sum() * left
        full = open_ & (given + want >= capacity)
        if not full.any():
            return given + want
        given[full] = capacity[full]
        open_ &= ~full
        left = min(total, capacity[shares > 0].sum()) - given.sum()
        given[open_] = 0
    return given


def _rates(member: np.ndarray, cap: np.ndarray, weight: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The rates after the given moves: every step goes down the gradient and back into [0, cap].

    A row's step is the inverse of the weight of its sources. With such steps the update's matrix is nonnegative and has
    the weights as an eigenvector of eigenvalue 1, so none is larger and the steps never swing.
    """
    rate = np.minimum(1.0, cap)
    step = 1 / np.maximum(member @ weight, 1e-12)
    for move in moves:
        rate = np.clip(rate - step * (member @ move), 0.0, cap)
    return rate


def _step(member: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, weight: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The expected tokens of the sources at the rates that the moves lead to."""
    return (member * (_rates(member, member @ repeats, weight, moves) * tokens)[:, None]).sum(0)


def group_sums(groups: DataFrame, n: int) -> DataFrame:
    """(tokens, s0, ...): token-weighted sums over rows of like memberships: the same two likeliest sources with shares of
    the same level. At most n^2 * LEVELS^2 rows."""
    largest = F.array_max("member")
    first = F.array_position("member", largest)
    rest = F.transform("member", lambda x, i: F.when(i + 1 == first, F.lit(-1.0)).otherwise(x))
    second = F.array_max(rest)
    key = [first.alias("a"), F.array_position(rest, second).alias("b"), F.round(largest * LEVELS).alias("la"), F.round(second * LEVELS).alias("lb")]
    rows = groups.select(*key, F.col("tokens").cast("double").alias("tokens"), "member")
    return rows.groupBy("a", "b", "la", "lb").agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("member")[i]).alias(f"s{i}") for i in range(n)])


def fit_rates(groups: DataFrame, targets: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moves of projected-gradient least squares over ``groups`` (membership, tokens), and the weight of the sources.

    A document's rate follows from its membership and the moves alone, so no state is kept per document, and moves found
    on group sums go on over all rows.
    """
    n, total = len(targets), max(targets.sum(), 1.0)
    coarse = np.array([[float(r[c]) for c in ("tokens", *[f"s{i}" for i in range(n)])] for r in group_sums(groups, n).where("tokens > 0").collect()]).reshape(-1, n + 1)
    coarse = coarse[np.lexsort(coarse.T)]
    weight = coarse[:, 1:].sum(0) / total
    tokens, member = coarse[:, 0], coarse[:, 1:] / np.maximum(coarse[:, :1], 1e-300)
    moves: list[np.ndarray] = []

    def moved(got: np.ndarray) -> bool:
        """Whether the miss of ``got`` gave a further move."""
        miss = (got - targets) / total
        if np.abs(miss).max() < MISS or moves and np.abs(miss - moves[-1]).max() < MISS / 10:
            return False
        moves.append(miss)
        return True

    for _ in range(STEPS):
        if not moved(_step(member, tokens, repeats, weight, np.array(moves).reshape(-1, n))):
            break
    for _ in range(FINE_STEPS):
        done = np.array(moves).reshape(-1, n)

        def run(batches: Iterator[pa.RecordBatch], done: np.ndarray = done) -> Iterator[pa.RecordBatch]:
            got = np.zeros(n)
            for b in batches:
                rows = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, n)
                got += _step(rows, b.column(1).to_numpy(), repeats, weight, done)
            yield pa.RecordBatch.from_arrays([pa.array(list(range(n)), pa.int32()), pa.array(got)], names=["i", "got"])

        parts = groups.select("member", F.col("tokens").cast("double")).mapInArrow(run, "i int, got double").groupBy("i").agg(F.sum("got").alias("got")).collect()
        got = np.zeros(n)
        for r in parts:
            got[r.i] = r.got
        if not moved(got):
            break
    return np.array(moves).reshape(-1, n), weight


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizers: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the collection; ``source`` is the likeliest one where it was unknown.

    ``total_tokens`` is the size of the collection, by default that of the documents. The targets table has one row per
    source and is read by the driver; what is gathered from the documents is one number per source and bucket at most.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").collect()
    names = [r.source for r in wanted]
    schema = "doc_id bigint, source string, n_tokens bigint, copies int"
    shares = np.array([float(r.share or 0) for r in wanted])
    if not names or shares.sum() <= 0:
        return spark.createDataFrame([], schema)
    shares = shares / shares.sum()
    repeats = np.array([float(r.repeats or 0) for r in wanted])

    label = source_name(F.col("source"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label.alias("label"), F.xxhash64("text").alias("h"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (label.isNull() | label.isin(names)))
    counted = count_tokens(rows, ["doc_id", "label", "h"], tokenizers=tokenizers, name=name).where("n_tokens > 0")
    first = F.min(F.struct(F.col("label").isNull().alias("no"), "label", "h", "n_tokens")).alias("x")
    sized = written(counted.groupBy("doc_id").agg(first).select("doc_id", "x.label", "x.h", "x.n_tokens"), "sized")
    unknown = sized.where("label is null").join(posteriors(documents, names, shares.tolist()), ["doc_id", "h"])
    unknown = written(unknown.select("doc_id", "n_tokens", F.col("posterior").alias("member")), "unknown")
    one_hot = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(len(names))]))])
    whole = sized.where("label is not null").groupBy("label").agg(F.sum("n_tokens").alias("tokens")).select(one_hot[F.col("label")].alias("member"), "tokens")
    groups = written(whole.unionByName(unknown.select("member", F.col("n_tokens").alias("tokens"))).select("member", "tokens"), "groups")

    capacity_row = groups.select(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * F.col("member")[i] * float(repeats[i])).alias(f"c{i}") for i in range(len(names))]).first()
    capacity = np.array([float(capacity_row[f"c{i}"] or 0) for i in range(len(names))])
    goal = fill_targets(shares, capacity, float(total_tokens or capacity_row["all"] or 0))
    moves, weight = fit_rates(groups, goal, repeats)

    per_source = _rates(np.eye(len(names)), repeats, weight, moves)
    rate_of = F.create_map(*[x for s, r in zip(names, per_source) for x in (F.lit(s), F.lit(float(r)))])
    labelled = sized.where("label is not null").select("doc_id", F.col("label").alias("source"), "n_tokens", rate_of[F.col("label")].alias("rate"))

    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            member = np.array(b.column(2).to_pylist(), dtype=float).reshape(-1, len(names))
            likely = [names[i] for i in member.argmax(axis=1)] if len(member) else []
            limit = np.floor(repeats[member.argmax(axis=1)]) if len(member) else np.empty(0)
            rate = np.minimum(_rates(member, member @ repeats, weight, moves), limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(likely, pa.string()), b.column(1), pa.array(rate)], names=["doc_id", "source", "n_tokens", "rate"])

    rated = labelled.unionByName(unknown.select("doc_id", "n_tokens", "member").mapInArrow(soft, "doc_id bigint, source string, n_tokens bigint, rate double"))
    return _whole_copies(written(rated, "rated")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def _whole_copies(rated: DataFrame) -> DataFrame:
    """Whole copies for rates: the lower whole number, and one more for documents whose hash is below the source's cut.

    The cut is where the tokens of the extra copies meet the expected ones, found in a histogram of the hash and then in
    one of the bucket it falls into: two tables of at most BUCKETS rows a source.
    """
    h = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(BUCKETS * BUCKETS))
    rows = rated.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("bucket", F.floor(h / BUCKETS).cast("int")).withColumn("fine", (h % BUCKETS).cast("int"))
    extra = rows.where("part > 1e-6")
    need = {r.source: r.need for r in extra.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("part")).alias("need")).collect()}
    cuts: dict[str, tuple[int, int]] = {}
    left = dict(need)
    for r in extra.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).orderBy("source", "bucket").collect():
        if r.source in cuts:
            continue
        if r.t > left[r.source]:
            cuts[r.source] = (r.bucket, 0)
        else:
            left[r.source] -= r.t
    if cuts:
        at = F.create_map(*[x for s, (b, _) in cuts.items() for x in (F.lit(s), F.lit(b))])
        for r in extra.where(F.col("bucket") == at[F.col("source")]).groupBy("source", "fine").agg(F.sum("n_tokens").alias("t")).orderBy("source", "fine").collect():
            b, fine = cuts[r.source]
            if r.t <= 2 * left[r.source]:
                left[r.source] -= r.t
                cuts[r.source] = (b, r.fine + 1)
            else:
                left[r.source] = -1.0
    top = {s: cuts.get(s, (BUCKETS, 0)) for s in need}
    if not top:
        return rows.withColumn("copies", F.col("base"))
    cut = F.create_map(*[x for s, (b, f) in top.items() for x in (F.lit(s), F.lit(b * BUCKETS + f))])
    more = (F.col("part") > 1e-6) & (F.col("bucket") * BUCKETS + F.col("fine") < cut[F.col("source")])
    return rows.withColumn("copies", F.col("base") + F.when(more, 1).otherwise(0))


def shares_reached(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, copies, tokens, reached_share) for every target."""
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share").join(got, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    total = got.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    return rows.withColumn("reached_share", F.round(F.col("tokens") / F.lit(float(max(total, 1))), 6))
