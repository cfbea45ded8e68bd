import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.errors import InvalidMode, InvalidPattern
from sondage.operators import fusion, pattern, postings, text_search, vector_search
from sondage.operators.embedding import DummyEmbedder, embed, embed_all
from sondage.plans.search import Mode, fused_hits

TF = [(1, "fn authenticate(user: &str, password: &str) -> Result<Token, Error>"), (2, "fn calculate_total(items: &[Item]) -> f64")]
TRIO = [
    (1, "function", "authenticate", "fn authenticate(user: &str) -> Result<Token, AuthError>"),
    (2, "function", "calculate", "fn calculate(x: f64, y: f64) -> f64"),
    (3, "struct", "AppConfig", "pub struct AppConfig"),
]


def _trio(spark):
    return spark.createDataFrame([(*r, r[3] + " {\n}") for r in TRIO], "id bigint, kind string, name string, signature string, body string")


def test_token_search(spark):
    built = postings.build_postings(spark.createDataFrame(TF, "id bigint, body string"))
    rows = postings.token_search(built, "authenticate user password").collect()
    assert rows[0].chunk_id == 1 and rows[0].score == pytest.approx(1.0)
    assert postings.token_search(built, "a !").count() == 0
    twice = postings.token_search(built, "user user password").collect()
    assert twice[0].score == pytest.approx(1.0)


def test_remove_and_add(spark):
    built = postings.build_postings(spark.createDataFrame(TF, "id bigint, body string"))
    gone = postings.remove_chunks(built, spark.createDataFrame([(1,)], "chunk_id bigint"))
    assert {r.chunk_id for r in gone.collect()} == {2}
    assert postings.add_postings(built, built).agg(F.sum("freq")).first()[0] == 2 * built.agg(F.sum("freq")).first()[0]


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, None), (6, [float("nan"), 1.0, 0.0])], "chunk_id bigint, embedding array<float>")
    rows = vector_search.search_vector(v, [0.9, 0.1, 0.0], 6).collect()
    assert [r.chunk_id for r in rows[:2]] == [1, 2]
    assert [r.score for r in rows[2:]] == [0.0] * 4
    assert [r.chunk_id for r in vector_search.search_vector(v, [0.9, 0.1, 0.0], 6, 0.5).collect()] == [1]
    assert all(r.score == 0 for r in vector_search.search_vector(v, [0.0, 0.0, 0.0]).collect())


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [2.0, 0.0, 0.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vector_search.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, 0.0, 0.0]


def test_batch_equals_single(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id bigint, embedding array<double>").repartition(5)
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.chunk_id) for r in vector_search.search_vectors(v, q, 4, block=3).collect()}
    for i in range(0, 200, 50):
        one = vector_search.search_vector(v, x[i], 4, -1.0).collect()
        assert {(i, r.chunk_id) for r in one} == {p for p in got if p[0] == i}


def _hits(spark, ids):
    return spark.createDataFrame([(c, 1.0 - n / 10) for n, c in enumerate(ids)], "chunk_id bigint, score double")


def test_rrf(spark):
    rows = {r.chunk_id: r for r in fusion.rrf_fuse(_hits(spark, [1, 2, 3]), _hits(spark, [2, 3, 4])).collect()}
    want = {2: 1 / 62 + 1 / 61, 3: 1 / 63 + 1 / 62, 1: 1 / 61, 4: 1 / 63}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r.fused_score for k, r in rows.items()}
    assert rows[1].semantic_score is None and rows[4].text_score is None
    assert fusion.rrf_fuse(_hits(spark, range(5)), _hits(spark, range(5, 10)), top_k=3).count() == 3
    empty = _hits(spark, [1]).limit(0)
    assert fusion.rrf_fuse(empty, empty).count() == 0
    three = {r.chunk_id: r.fused_score for r in fusion.rrf_fuse(_hits(spark, [1, 2]), _hits(spark, [2, 3]), _hits(spark, [3, 4])).collect()}
    assert len(three) == 4 and three[2] > three[1] and three[3] > three[4]
    swapped = {r.chunk_id: r.fused_score for r in fusion.rrf_fuse(_hits(spark, [2, 3]), _hits(spark, [1, 2]), _hits(spark, [3, 4])).collect()}
    assert swapped == pytest.approx(three)


def test_pattern_parse():
    p = pattern.parse("fn(string) -> number")
    assert (p.kind, p.name, p.params, p.returns) == ("function", None, ["string"], "number")
    p = pattern.parse("async fn(*) -> Result")
    assert p.qualifiers == ["async"] and p.returns == "Result"
    assert pattern.parse("fn(string, number) -> bool").params == ["string", "number"]
    assert pattern.parse("fn()").params == []
    assert pattern.parse("class *Service").name == "*Service"
    assert pattern.parse("authenticate").name == "authenticate"
    assert pattern.parse("* foo").kind == "any"
    for bad in ("", "  ", "async pub"):
        with pytest.raises(InvalidPattern):
            pattern.parse(bad)


def test_types():
    for want, actual in [("string", "String"), ("string", "&str"), ("number", "i32"), ("bool", "boolean"), ("Result*", "Result<String, Error>"), ("*", "x"), ("Token", "Option<Token>")]:
        assert pattern.type_matches(want, actual), (want, actual)
    assert not pattern.type_matches("string", "i32")
    assert pattern.param_types("fn authenticate(user: &str, password: String) -> bool") == ["str", "String"]
    assert pattern.param_types("fn f(a: Map<K, V>, b: &mut T)") == ["Map<K, V>", "T"]
    assert pattern.param_types("func (s *S) F(a int)") == ["*S"]
    assert pattern.param_types("fn f(") == []
    assert pattern.params_score(["string", "*"], ["str", "i32"]) == 1.0
    assert pattern.params_score(["string", "bool"], ["str"]) == 0.0


def test_returns_and_globs(spark):
    sigs = [("def foo(x: int) -> bool:", "bool"), ("fn f() -> Result<T> {", "Result<T>"), ("function f(a): string[] {", "string[]"), ("func F(a int)", None), ("fn f() ->", None)]
    df = spark.createDataFrame(sigs, "s string, want string").select("want", pattern.return_type(F.col("s")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    names = spark.createDataFrame([("MainConfig",), ("AppConfig",), ("ConfigManager",)], "n string")
    assert [r.m for r in names.select(pattern.wildcard_match(F.col("n"), "*Config").alias("m")).collect()] == [True, True, False]


def test_pattern_search(spark):
    chunks = _trio(spark)
    assert pattern.search_pattern(chunks, "fn(*) -> Result").first().chunk_id == 1
    assert [r.chunk_id for r in pattern.search_pattern(chunks, "struct *Config").collect()] == [3]
    assert pattern.search_pattern(chunks, "fn calculate(*)").first().chunk_id == 2
    assert pattern.search_pattern(chunks, "nothing").first().score == pytest.approx(0.5)


def test_dummy_embedder(spark):
    e = DummyEmbedder(16)
    out = e.embed_batch(["abc", "", "abc"])
    assert np.allclose(np.linalg.norm(out, axis=1), 1) and (out[0] == out[2]).all() and not (out[0] == out[1]).all()
    h = 5381
    for b in b"abc":
        h = (h * 33 + b) % 2**64
    h = (h * 6364136223846793005 + 1442695040888963407) % 2**64
    raw = np.float32(h >> 33) / np.float32(2**32 - 1) * 2 - 1
    assert math.copysign(1, raw) == math.copysign(1, out[0][0])
    seen = []
    embed_all(["x"] * 5, e, 2, lambda done, n: seen.append((done, n)))
    assert seen == [(2, 5), (4, 5), (5, 5)]
    rows = embed(spark.createDataFrame([(1, "abc"), (2, None)], "chunk_id bigint, summary string"), e).orderBy("chunk_id").collect()
    assert np.allclose(rows[0].embedding, out[0]) and np.allclose(rows[1].embedding, out[1])


def test_hybrid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "chunk_id bigint, embedding array<float>")
    rows = fused_hits(_trio(spark), v, "authenticate", Mode.HYBRID, query_vector=[1.0, 0.0]).collect()
    assert rows[0].chunk_id == 1 and rows[0].text_score is not None
    assert Mode.parse("HyBrid") is Mode.HYBRID
    with pytest.raises(InvalidMode):
        Mode.parse("nope")


def test_recall_of_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 600)] + rng.standard_normal((600, 16)) * 0.3
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0, float("nan")])], "chunk_id bigint, embedding array<float>")
    centroids = vector_search.fit_cells(v)
    stored = vector_search.in_cells(v, centroids).cache()
    assert stored.count() == 603 and stored.where("cell = -1").count() == 3 and centroids.count() == 25
    hits = 0
    for i in range(0, 600, 60):
        exact = {r.chunk_id for r in vector_search.search(v, x[i], 5).collect()}
        hits += len(exact & {r.chunk_id for r in vector_search.search_cells(stored, centroids, x[i], 5).collect()})
    assert hits >= 0.9 * 50
    assert vector_search.search(v, x[0], 5, method="cells").count() == 5
    assert vector_search.search(v.limit(0), x[0], 5, method="cells").count() == 0
    with pytest.raises(ValueError):
        vector_search.search(v, x[0], method="graph")
    with pytest.raises(ValueError):
        vector_search.search_vectors(v, spark.range(vector_search.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding")))


def test_quick_test_of_whole_texts(spark):
    """The quick test before texts are split loses no line, whatever its ends; repeated rows count once."""
    bodies = ["one\ntwo\n", "x\r\nend here\r\nz", "tail", "", None, "a\nb\n\nc", "Straße\nSTALE", "end\n here"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)] + [(1, bodies[1])], "id bigint, body string")
    for rx in ("^two$", "here$", "^$", "stale", "e\\s*$", "^[^a]$", "tail|two", "end\\s+here", "(?<!x)tail", "e*+$", "\\Ctail".replace("\\C", "\\A"), "\\bz\\b"):
        java = re.compile(rx.replace("*+", "*"), re.I)
        want = {}
        for i, b in enumerate(bodies):
            lines = re.split("\r?\n", b) if b is not None else []
            lines = lines[:-1] if lines and lines[-1] == "" else lines
            if hit := [n for n, line in enumerate(lines) if java.search(line)]:
                want[i] = hit
        assert {r.chunk_id: r.matched_lines for r in text_search.regex_search(df, rx).collect()} == want, rx


def test_cells_batch_at_full_share_is_exact(spark, monkeypatch):
    """Tiles of 64 rows and parts of 64 queries at most; ties across tiles, repeated vectors and rows without a direction."""
    monkeypatch.setattr(vector_search, "STEP_ROWS", 64)
    monkeypatch.setattr(vector_search, "TILE_VALUES", 1)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((350, 8)), np.tile(rng.standard_normal((30, 8)), (5, 1)), np.tile(rng.standard_normal(8), (100, 1))]).astype(np.float32)
    ids = rng.permutation(len(x))
    odd = [(None, [1.0] * 8), (900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)]
    v = spark.createDataFrame([(int(i), [float(a) for a in x[k]]) for k, i in enumerate(ids)] + odd, "chunk_id bigint, embedding array<float>")
    centroids = vector_search.fit_cells(v)
    stored = vector_search.in_cells(v, centroids).cache()
    q = v.withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in vector_search.search_cells_batch(stored, centroids, q, 10, share=1.0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    scores = np.array([[math.fsum(a * b) for b in unit] for a in unit])
    assert len(got) == len(x)
    for k, i in enumerate(ids):
        best = np.lexsort((ids, -scores[k].round(12)))[:10]
        assert [c for _, c in sorted(got[i])] == ids[best].tolist()
        assert np.allclose([-s for s, _ in sorted(got[i])], scores[k][best], rtol=0, atol=1e-12)
    for some, asked, k in ((stored.limit(0), q, 10), (stored, q.limit(0), 10), (stored, q, 0)):
        assert vector_search.search_cells_batch(some, centroids, asked, k).count() == 0
    every = {(r.query_id, r.chunk_id): r.score for r in vector_search.search_cells_batch(stored, centroids, q, 600, share=1.0).collect()}
    near = vector_search.search_cells_batch(stored, centroids, q, 10).collect()
    assert len(every) == len(x) ** 2 and near and all(every[r.query_id, r.chunk_id] == r.score for r in near)


def test_tiles():
    assert vector_search._tiles([3, 0, 7, 25, 4, 6, 1], 10) == ([(0, 3), (3, 4), (3, 4), (3, 4), (4, 6), (6, 7)], [0, 0, 0, 1, 4, 4, 5], [1, 1, 1, 3, 1, 1, 1])
