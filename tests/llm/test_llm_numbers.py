import math
from collections import Counter, defaultdict
from functools import partial
from statistics import median

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondage.llm import score_fusion as sf
from sondage.llm import source_mixing as sm
from sondage.llm import term_distinctiveness as td
from sondage.llm import vector_neighbours as vn


def _g2(k11, row, col, n):
    cells = [(k11, row, col), (row - k11, row, n - col), (col - k11, n - row, col), (n - row - col + k11, n - row, n - col)]
    g = 2 * sum(k * math.log(k * n / (r * c)) for k, r, c in cells if k > 0)
    return g if k11 * n >= row * col else -g


@pytest.mark.parametrize("heavy", [2000, 1])
def test_term_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(td, "HEAVY_SHARE", heavy)
    rng = np.random.default_rng(1)
    rows = [(f"t{rng.zipf(1.6) % 50}", int(c), int(rng.integers(1, 6)), "p") for c in range(40) for _ in range(12)]
    rows = list({(t, c): (t, c, f, p) for t, c, f, p in rows}.values())
    dirt = [rows[0], (None, 1, 3, "p"), ("", 1, 3, "p"), ("x y", 1, 3, "p"), ("t1", 999, 3, "p"), ("t1", 1, None, "p"), ("t2", 1, 0, "p"), ("é", 1, 3, "p"), ("t1", None, 2, "p")]
    postings = spark.createDataFrame(rows + dirt, "token string, chunk_id bigint, freq bigint, project string").withColumn("df", F.lit(1))
    chunks = spark.createDataFrame([(c,) for c in [*range(40), 0, None]], "id bigint")
    n, by_row, by_term, holders = sum(r[2] for r in rows), Counter(), Counter(), Counter()
    for t, c, f, _ in rows:
        by_row[c] += f
        by_term[t] += f
        holders[t] += 1
    got = {(r.token, r.chunk_id): r for r in td.term_scores(postings, chunks).collect()}
    assert set(got) == {(t, c) for t, c, _, _ in rows}
    for t, c, f, _ in rows:
        r = got[t, c]
        assert (r.freq, r.df, r.cf) == (f, holders[t], by_term[t])
        assert r.llr == pytest.approx(_g2(f, by_row[c], by_term[t], n), abs=1e-6)
    assert td.term_scores(postings.limit(0), chunks).count() == 0
    ranked = defaultdict(list)
    for r in td.most_distinctive(td.term_scores(postings, chunks), 3).collect():
        ranked[r.chunk_id].append((-r.llr, r.token))
    full = defaultdict(list)
    for r in td.term_scores(postings, chunks).collect():
        full[r.chunk_id].append((-r.llr, r.token))
    assert {k: sorted(v) for k, v in ranked.items()} == {k: sorted(v)[:3] for k, v in full.items()}


def test_rare_terms_of_a_heavy_chunk(spark):
    """Chunk 0 holds a third of all counts; two equal chunks score exactly 0."""
    import duckdb

    from sondage.llm.queries import SQL

    third = [("shared", c, 3) for c in range(4)] + [("only0", 0, 97), *((f"only{c}", c, 47 + c) for c in range(1, 4)), ("only4", 4, 44)]
    assert sum(f for _, c, f in third if c == 0) * 3 == sum(f for *_, f in third)
    for rows in (third, [(t, c, 3) for t in ("x", "y") for c in (1, 2)]):
        postings = spark.createDataFrame(rows, "token string, chunk_id bigint, freq bigint")
        chunks = spark.createDataFrame([(c,) for c in range(5)], "id bigint")
        db = duckdb.connect()
        db.register("postings", postings.toArrow())
        db.register("chunks", chunks.toArrow())
        scores = td.term_scores(postings, chunks)
        assert scores.where("llr <= 0 and freq >= 3 and df between 2 and 6").count() > 0
        got = [tuple(r) for r in td.rare_shared_terms(scores).collect()]
        assert sorted(got) == sorted(db.execute(SQL["p2_found"]).fetchall())


def _fuse_plain(rows):
    by = defaultdict(dict)
    for q, c, *s in rows:
        by[q][c] = [None if x is None or x != x else x for x in s]
    out = {}
    for q, items in by.items():
        parts = defaultdict(float)
        for k in range(3):
            have = {c: s[k] for c, s in items.items() if s[k] is not None}
            mid = median(have.values()) if have else 0
            mad = median(abs(v - mid) for v in have.values()) if have else 0
            mean = sum(abs(v - mid) for v in have.values()) / len(have) if have else 0
            scale = mad * 1.4826 if mad > 0 else mean * 1.2533
            for c in items:
                z = -sf.CLIP if c not in have else max(-sf.CLIP, min(sf.CLIP, (have[c] - mid) / scale)) if scale > 0 else 0
                parts[c] += -math.log1p(math.exp(-z)) / 3
        for c in items:
            out[q, c] = round(math.exp(parts[c]), 9)
    return out


def test_fuse_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(q, c, float(rng.normal() * 100), float(rng.random()), float(rng.integers(0, 4)) / 3) for q in range(3) for c in range(60)]
    rows = [(q, c, None if c % 7 == 0 else a, float("nan") if c % 11 == 0 else b, s) for q, c, a, b, s in rows] + [(5, 1, 1.0, 1.0, 1.0), (6, 1, None, None, None)]
    df = spark.createDataFrame(rows + rows[:20] + [(None, 1, 1.0, 1.0, 1.0)], "query_id bigint, chunk_id bigint, text_score double, semantic_score double, ast_score double").withColumn("rank", F.lit(0))
    want = _fuse_plain(rows)
    got = {(r.query_id, r.chunk_id): r for r in sf.fuse_scores(df).collect()}
    assert set(got) == set(want)
    assert all(got[k].fused == pytest.approx(v, abs=2e-9) for k, v in want.items())
    for q in range(3):
        order = sorted((k for k in got if k[0] == q), key=lambda k: (-got[k].fused, k[1]))
        assert [got[k]["rank"] for k in order] == list(range(1, 61))
    top = {(r.query_id, r.chunk_id) for r in sf.agreed_top(sf.fuse_scores(df)).collect()}

    def ahead(q, c, k):
        v = {r[1]: r[2 + k] for r in rows if r[0] == q and r[2 + k] is not None and r[2 + k] == r[2 + k]}
        return sum(x > v[c] for x in v.values()) if c in v else 99

    assert top == {(r[0], r[1]) for r in rows if all(ahead(r[0], r[1], k) < 10 for k in range(3))}
    assert sf.fuse_scores(df.limit(0)).count() == 0


def _vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(3)


def test_similar_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] + rng.standard_normal(64) * 0.25
        x[i + 2] = x[i] * 4 if i % 2 else x[i] + rng.standard_normal(64) * 0.3
    x[2990] = x[10]
    nan = [float("nan")] + [1.0] * 63
    dirt = [(9001, None), (9002, [0.0] * 64), (9003, nan), (9004, [1.0] * 32), (9005, []), (5, [float(v) for v in x[5]]), (None, [1.0] * 64)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.where(np.triu(unit @ unit.T, 1) >= 0.9)
    want = set(zip(a.tolist(), b.tolist()))
    got = {(r.chunk_id_a, r.chunk_id_b) for r in vn.similar_pairs(_vectors(spark, x, dirt)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert vn.similar_pairs(_vectors(spark, x, dirt).limit(0)).count() == 0


def _wanted(x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.where(np.triu(unit @ unit.T, 1) >= least)
    return set(zip(a.tolist(), b.tolist()))


def test_pairs_of_crowded_vectors(spark):
    """More partners than a node keeps: 40 vectors that are all similar, and a crowd joined in several stripes."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((240, 64))
    x[:40] = x[0] + rng.standard_normal((40, 64)) * 0.2
    want = _wanted(x)
    assert len(want) == 780
    got = {(r.chunk_id_a, r.chunk_id_b) for r in vn.similar_pairs(_vectors(spark, x)).collect()}
    assert got == want
    crowd = np.concatenate([rng.standard_normal(64) + rng.standard_normal((n, 64)) * 0.24 for n in (150, 60, 9)] + [rng.standard_normal((300, 64))])
    graph = vn.build_graph(_vectors(spark, crowd))
    floor = vn.code_floor(0.9, 64)
    full = {r.id for r in graph.nodes.where(F.col("worst") >= floor).collect()}
    pairs = {(r.x, r.y) for r in vn.full_pairs(graph.nodes, floor, stripe=50).collect()}
    assert len(full) > 150 and {p for p in _wanted(crowd) if set(p) <= full} <= pairs <= _wanted(crowd, floor - 0.05)


def test_copies_stay_classes(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((50, 64))
    x[10:40] = x[0]
    x[41] = x[0] + rng.standard_normal(64) * 0.1
    pairs, members = vn.similar_classes(_vectors(spark, x))
    assert [(r.class_a, r.class_b) for r in pairs.collect()] == [(0, 41)] and members.count() == 50
    links = {r.id: r.links for r in vn.class_links(pairs, members).collect()}
    assert links[0] == links[25] == links[41] == 31 and links[5] == 0
    assert vn.expanded_pairs(pairs, members).count() == 31 * 32 // 2
    assert {(r.chunk_id_a, r.chunk_id_b) for r in vn.expanded_pairs(pairs, members).collect()} == _wanted(x)


def test_hub_of_many_lists(spark):
    """A node in 100,000 lists sends and gets no more than its best members of what each task gathered."""

    def nodes(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            rng = np.random.default_rng(int(ids[0]) if len(ids) else 0)
            q = [r.tobytes() for r in rng.integers(1, 120, (len(ids), 64)).astype(np.int8)]
            links = [np.array([(0 if i else 1, 0.5)], vn._LINK).tobytes() for i in ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(q), pa.array(links), pa.array(np.ones(len(ids), np.int32)), pa.array(np.full(len(ids), -2, np.float32))], names=["id", "q", "links", "fresh", "worst"])

    graph = spark.range(0, 100_001, 1, 4).mapInArrow(nodes, vn._GRAPH)
    sent = graph.select("id", "links", "fresh").mapInArrow(partial(vn._links_both_ways, 5), vn._MEMBER)
    assert sent.where("node = 0").count() <= 4 * 10
    after = vn.descend(graph).select("id", "links").collect()
    assert len(after) == 100_001 and all(len(r.links) >= vn._LINK.itemsize for r in after)


def test_search_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 64))[rng.integers(0, 60, 2000)] + rng.standard_normal((2000, 64)) * 0.7
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found, hits = defaultdict(set), 0
    for r in vn.neighbours(_vectors(spark, x), k=5, every=50).collect():
        found[r.chunk_id].add(r.other)
    for i in range(0, 2000, 50):
        s = unit @ unit[i]
        s[i] = -2
        hits += len(found[i] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * 40) >= 0.9


def test_fill_targets():
    got = sm.fill_targets(np.array([0.5, 0.3, 0.2]), np.array([100.0, 10.0, 100.0]), 100.0)
    assert got == pytest.approx([90 * 5 / 7, 10, 90 * 2 / 7])
    assert sm.fill_targets(np.array([0.5, 0.5]), np.array([10.0, 0.0]), 100.0) == pytest.approx([10, 0])


def test_mixture(spark):
    rows = [(i, "alpha beta gamma delta " * 5, "Big-One", "py") for i in range(200)] + [(1000 + i, "omega psi chi phi " * 5, "small ", "go") for i in range(20)]
    rows += [(2000 + i, "omega psi chi phi " * 5, None, "go") for i in range(5)] + [(3000, None, "small", "go"), (3001, "", "small", "go"), (3002, "x y", "elsewhere", "go"), (0, "alpha beta gamma delta " * 5, "Big-One", "py")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("n_tokens", F.lit(0))
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = sm.mixed(docs, targets)
    got = {r.doc_id: r for r in mix.collect()}
    assert all(r.copies <= (1 if r.source == "big_one" else 3) for r in got.values())
    assert {r.source for i, r in got.items() if 2000 <= i < 2005} == {"small"}
    shares = {r.source: r for r in sm.shares_reached(mix, targets).collect()}
    assert shares["small"].copies >= 60 and shares["none"].tokens == 0
    part = {r.source: r.reached_share for r in sm.shares_reached(sm.mixed(docs, targets, total_tokens=1000), targets).collect()}
    assert part["big_one"] == pytest.approx(0.5 / 0.9, abs=0.06) and part["small"] == pytest.approx(0.4 / 0.9, abs=0.06)
    assert sm.mixed(docs.limit(0), targets).count() == 0 and sm.mixed(docs, targets.limit(0)).count() == 0


def test_fit_on_group_sums_and_rows(spark):
    """The fit meets its targets over the rows themselves; the groups it starts on are bounded."""
    rng = np.random.default_rng(3)
    member = rng.dirichlet([0.4, 0.4, 0.4], 3000)
    tokens = rng.integers(1, 500, 3000)
    groups = spark.createDataFrame([([float(v) for v in m], int(t)) for m, t in zip(member, tokens)], "member array<double>, tokens bigint")
    assert sm.group_sums(groups, 3).count() <= 9 * sm.LEVELS**2
    goal, repeats = tokens.sum() * np.array([0.5, 0.3, 0.2]), np.array([3.0, 3.0, 3.0])
    moves, scale = sm.fit_rates(groups, goal, repeats)
    got = sm._step(member, tokens.astype(float), repeats, scale, moves)
    assert np.abs(got - goal).max() <= 2e-3 * goal.sum()


def test_texts_of_one_id_are_one_row(spark):
    rows = [(i, f"alpha beta {i}", "big", "py") for i in range(20)] + [(50, "alpha", None, "py"), (50, "alpha beta gamma delta", None, "go"), (50, "alpha", None, "rs")]
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    frames = [spark.createDataFrame(r, "doc_id bigint, text string, source string, lang string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 3))]
    one, other = (sorted(map(tuple, sm.mixed(f, targets).collect())) for f in frames)
    assert one == other and sum(r[0] == 50 for r in one) == 1


def test_classifier_held_out():
    rng = np.random.default_rng(0)
    words = [[f"w{c}{i}" for i in "abcdefgh"] + ["the", "of", "and"] for c in "xyz"]
    labels = rng.integers(0, 3, 600)
    texts = [" ".join(rng.choice(words[c], 12)) for c in labels]
    w, b = sm.fit_classifier(texts[:400], [[None] * 3] * 400, labels[:400], 3)
    p = sm._softmax(sm._features(texts[400:], [[None] * 3] * 200) @ w + b)
    assert (p.argmax(1) == labels[400:]).mean() > 0.95
