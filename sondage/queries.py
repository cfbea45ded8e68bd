"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import paths
from sondage.functions.lines import line_count
from sondage.operators import change_capture, chunking, fusion, incremental, pattern, postings, summary, text_search, vector_search
from sondage.operators.embedding import DummyEmbedder, embed
from sondage.plans.search import Mode, fused_hits, with_chunks
from sondage.sources.scan import latest_entries
from sondage.storage import scratch, table, written
from sondage.streaming.watch import last_events

Query = Callable[[SparkSession, str], DataFrame]
REGEX, TOKENS, PATTERN, PARAMS = "stale|frozen", "cache budget cache", "pub fn *cache* -> bool", "fn(string, number) -> bool"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as they are stored, some of them repeatedly."""
    return table(spark, d, "chunks")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as they are stored, some of them repeatedly."""
    return table(spark, d, "vectors").where("embedding is not null")


def _semantic(spark: SparkSession, d: str, top_k: int = 20, threshold: float = 0.0) -> DataFrame:
    return vector_search.search_vector(_vectors(spark, d), _asked(spark, d), top_k, threshold, repeated=True)


def _asked(spark: SparkSession, d: str) -> list[float]:
    """The query vector: the first of the embeddings."""
    return table(spark, d, "embeddings").where("vec_id = 0").first().embedding


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _fused(df: DataFrame) -> DataFrame:
    return _rounded(df, "fused_score", "text_score", "semantic_score", "ast_score").drop("matched_lines")


def text_regex_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(text_search.regex_search(_chunks(spark, d), REGEX).withColumn("matched_lines", F.array_join(F.col("matched_lines").cast("array<string>"), ",")), "score")


def regex_match_lines(spark: SparkSession, d: str) -> DataFrame:
    return text_search.matching_lines(table(spark, d, "documents"), REGEX)


def match_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return text_search.match_context(text_search.regex_search(chunks, REGEX), chunks)


def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return postings.build_postings(_chunks(spark, d).dropDuplicates(["id"]))


def entry_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings.entry_postings(table(spark, d, "index_entries").dropDuplicates(["chunk_id"]))


def token_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(postings.token_search(postings.build_postings(_chunks(spark, d).dropDuplicates(["id"])), TOKENS), "score")


def token_search_stored(spark: SparkSession, d: str) -> DataFrame:
    """Token search in stored postings: usable rows, once each."""
    stored = table(spark, d, "postings").where("freq >= 1 and token is not null").dropDuplicates()
    return _rounded(postings.token_search(stored, TOKENS), "score")


def remove_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Postings without those of chunks that are gone."""
    stored = table(spark, d, "postings").select("token", "chunk_id", "freq")
    there = table(spark, d, "chunks").select(F.col("id").alias("chunk_id")).distinct()
    gone = stored.select("chunk_id").distinct().join(there, "chunk_id", "left_anti")
    return postings.remove_chunks(stored, gone)


def upsert_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Index entries' vectors put over the stored ones."""
    entries = table(spark, d, "index_entries").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    return postings.upsert_vectors(_vectors(spark, d).dropDuplicates(["chunk_id"]), entries).select("chunk_id", F.size("embedding").cast("bigint").alias("n"))


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vector_search.search_vector(table(spark, d, "embeddings"), _asked(spark, d), id_column="vec_id"), "score")


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search in the nearest cells of vectors, each once."""
    return _rounded(vector_search.search(_vectors(spark, d).dropDuplicates(["chunk_id"]), _asked(spark, d), 10, method="cells"), "score")


def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search finds nine of ten of the ten nearest of every fiftieth vector, against all rows."""
    vectors = _vectors(spark, d).where(F.size("embedding") == 64)
    centroids = written(vector_search.fit_cells(vectors), "centroids")
    stored = written(vector_search.in_cells(vectors.dropDuplicates(["chunk_id"]), centroids), "cells").where("cell >= 0")
    queries = stored.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector_search.search_cells_batch(stored, centroids, queries, 10, share=1.0)
    found = vector_search.search_cells_batch(stored, centroids, queries, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_semantic(spark, d, 50, 0.3), "score")


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every fiftieth embedding, against all."""
    rows = table(spark, d, "embeddings")
    return _rounded(vector_search.search_vectors(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5, id_column="vec_id"), "score")


def rrf_three_way(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    text, ast = text_search.regex_search(chunks, REGEX), pattern.search_pattern(chunks, PATTERN)
    return _fused(fusion.rrf_fuse(text, _semantic(spark, d), ast))


def rrf_two_way(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return _fused(fusion.rrf_fuse(text_search.regex_search(chunks, REGEX), _semantic(spark, d)))


def fuse_text_only(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.fuse_only(text_search.regex_search(_chunks(spark, d), REGEX), "text"))


def fuse_semantic_only(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.fuse_only(_semantic(spark, d), "semantic"))


def fuse_ast_only(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.fuse_only(pattern.search_pattern(_chunks(spark, d), PATTERN), "ast"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    hits = fused_hits(chunks, _vectors(spark, d), REGEX, Mode.HYBRID, query_vector=_asked(spark, d), repeated=True)
    return _rounded(with_chunks(hits, chunks).select("chunk_id", "fused_score", "file_path", "kind", "name"), "fused_score")


def chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fallback_chunks(table(spark, d, "documents"))


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut by syntax."""
    return chunking.chunk_files(table(spark, d, "documents"))


def signature_extract(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", summary.signature(F.col("body")).alias("signature")).dropDuplicates(["id"])


def summary_build(spark: SparkSession, d: str) -> DataFrame:
    return summary.summaries(_chunks(spark, d)).dropDuplicates(["chunk_id"])


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", line_count(F.col("text")).cast("bigint").alias("lines"))


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    found = paths.language(F.col("path"))
    return table(spark, d, "scan_entries").select("path", found.alias("language")).distinct()


def source_filter(spark: SparkSession, d: str) -> DataFrame:
    return latest_entries(table(spark, d, "scan_entries")).where(paths.should_index(F.col("path"), F.col("size"))).select("path", "size")


def watch_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_entries").where(paths.is_watched(F.col("path"))).select("path").distinct()


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    globs = ["*.min.js", "*.min.css", "*.lock", "package-lock.json", "yarn.lock"]
    return table(spark, d, "documents").where(paths.is_excluded(F.col("file_path"), globs)).select("doc_id", "file_path")


def binary_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", paths.is_binary(F.col("text").cast("binary")).alias("is_binary"))


def latest_scan(spark: SparkSession, d: str) -> DataFrame:
    return latest_entries(table(spark, d, "scan_entries")).select("path", "size", F.unix_micros("seen_at").alias("seen_us"))


def ast_pattern_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pattern.search_pattern(_chunks(spark, d), PATTERN), "score")


def ast_struct_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pattern.search_pattern(_chunks(spark, d), "struct *Tree"), "score")


def ast_params_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(pattern.search_pattern(_chunks(spark, d), PARAMS), "score")


def return_types(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", pattern.return_type(F.coalesce("signature", "body")).alias("return_type")).dropDuplicates(["id"])


def wildcard_match(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where(pattern.wildcard_match(F.col("name"), "*TREE*")).select("id", "name").dropDuplicates(["id"])


def fuzzy_type_match(spark: SparkSession, d: str) -> DataFrame:
    found = _chunks(spark, d).select("id", pattern.return_type(F.col("signature")).alias("return_type"))
    return found.where(pattern.type_matches_column("number", F.col("return_type"))).dropDuplicates(["id"])


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The recorded state: of every path the row of the latest run that succeeded."""
    runs = table(spark, d, "index_runs").where("outcome = 'ok'").select("run_id")
    newest = F.max(F.struct("run_id", "mtime", "content_hash", "chunk_ids")).alias("s")
    return table(spark, d, "file_state").join(runs, "run_id", "left_semi").groupBy("path").agg(newest).select("path", "s.mtime", "s.content_hash", "s.chunk_ids")


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """Change detection by time first and hash where the time differs."""
    hashes = table(spark, d, "documents").select(F.col("file_path").alias("path"), incremental.content_hash(F.col("text")).alias("content_hash"))
    times = latest_entries(table(spark, d, "scan_entries")).select("path", F.col("modified").alias("mtime"))
    return incremental.detect_changes(hashes.join(times, "path", "left"), _state(spark, d))


def chunk_ids_to_remove(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of recorded paths that no document has any more."""
    state, there = _state(spark, d), table(spark, d, "documents").select(F.col("file_path").alias("path"))
    return incremental.chunk_ids_of(state, state.join(there, "path", "left_anti"))


def apply_deletions(spark: SparkSession, d: str) -> DataFrame:
    """The state left after those paths are forgotten."""
    state, there = _state(spark, d), table(spark, d, "documents").select(F.col("file_path").alias("path"))
    left, _ = incremental.apply_deletions(state, state.join(there, "path", "left_anti"))
    return left.select("path", F.lower("content_hash").alias("content_hash"))


def update_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after all documents are recorded anew, with the number of their chunks."""
    files = table(spark, d, "documents").select(F.col("file_path").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), incremental.content_hash(F.col("text")).alias("content_hash"))
    out = incremental.update_files(_state(spark, d), files, table(spark, d, "chunks"))
    return out.select("path", F.lower("content_hash").alias("content_hash"), F.coalesce(F.size("chunk_ids"), F.lit(-1)).cast("bigint").alias("n"))


def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").alias("seq"))
    return last_events(events)


def dummy_embed(spark: SparkSession, d: str) -> DataFrame:
    """The trial embedder's vectors, an element a row."""
    vectors = embed(summary.summaries(_chunks(spark, d)).dropDuplicates(["chunk_id"]), DummyEmbedder(64))
    return _rounded(vectors.select("chunk_id", F.posexplode("embedding").alias("element", "value")), "value").withColumns({"element": F.col("element").cast("bigint"), "value": F.col("value") + 0.0})


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts; the two distinct counts expand ids and paths, no other column."""
    ids = table(spark, d, "chunks").select(F.col("id").alias("i"), F.col("file_path").alias("p"), F.lit(None).cast("int").alias("n"))
    sizes = table(spark, d, "vectors").select(F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("string").alias("p"), F.size("embedding").alias("n"))
    return ids.unionByName(sizes).agg(F.countDistinct("i").alias("chunk_count"), F.countDistinct("p").alias("files"), F.max("n").cast("bigint").alias("embedding_dim"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    states = change_capture.valid_states(table(spark, d, "file_state"), table(spark, d, "index_runs"))
    log = change_capture.ChangeLog(spark, scratch(spark, "changes"))
    return log.run(lambda: change_capture.detect(table(spark, d, "documents"), states)).select("path", "status")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        text_regex_search, regex_match_lines, match_context, postings_build, entry_postings, token_search, token_search_stored, remove_chunks, upsert_vectors, knn_exact, knn_cells, knn_recall, knn_threshold, knn_batch,
        rrf_three_way, rrf_two_way, fuse_text_only, fuse_semantic_only, fuse_ast_only, hybrid_search, chunk_fallback, chunk_files, signature_extract, summary_build, line_counts,
        language_detect, source_filter, watch_filter, exclude_filter, binary_detect, latest_scan, ast_pattern_search, ast_struct_search, ast_params_search, return_types, wildcard_match,
        fuzzy_type_match, incremental_diff, chunk_ids_to_remove, apply_deletions, update_state, event_dedup, dummy_embed, index_status, p4_found,
    )
}

_LINES = "(CASE WHEN {0}[-1] = '' THEN {0}[:-2] ELSE {0} END)"
_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_C = r"c AS (SELECT DISTINCT * FROM chunks), split_ AS (SELECT *, regexp_split_to_array(body, '\r?\n') AS p FROM c), l AS (SELECT *, " + _LINES.format("p") + " AS lines FROM split_)"
_TEXT = f"""text_hits AS (SELECT chunk_id, ms, round(len(ms) + 10.0 * len(ms) / greatest(n, 1), 6) AS score FROM
    (SELECT id AS chunk_id, len(lines) AS n, list_filter(list_transform(lines, lambda x, i: CASE WHEN regexp_matches(x, '(?i){REGEX}') THEN i - 1 END), lambda v: v IS NOT NULL) AS ms FROM l)
    WHERE len(ms) > 0 ORDER BY score DESC, chunk_id LIMIT 20)"""
_V = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT DISTINCT chunk_id, embedding FROM vectors WHERE embedding IS NOT NULL),
s AS (SELECT chunk_id, CASE WHEN len(embedding) <> len(q.e) THEN 0.0 ELSE list_dot_product(CAST(embedding AS DOUBLE[]), q.e)
    / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.e, q.e))) END AS x FROM v, q),
sims AS (SELECT chunk_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS score FROM s)"""
_SEM = _V + ", sem_hits AS (SELECT chunk_id, score FROM sims ORDER BY score DESC, chunk_id LIMIT 20)"
def _return(x: str) -> str:
    arrow = f"regexp_replace({_trim(f"substr({x}, instr({x}, '->') + 2)")}, '[{{:\\s]+$', '')"
    tail = _trim(f"regexp_extract({x}, '(?s)[^)]*$')")
    colon = f"regexp_replace({_trim(f'substr({tail}, 2)')}, '[{{\\s]+$', '')"
    return f"CASE WHEN instr({x}, '->') > 0 AND {arrow} <> '' THEN {arrow} WHEN contains({x}, ')') AND starts_with({tail}, ':') AND {colon} <> '' THEN {colon} END"


_AST = f"""ast_hits AS (SELECT chunk_id, score FROM (SELECT id AS chunk_id, (0.3
    + 0.1 * CASE WHEN contains(lower(coalesce(signature, '') || ' ' || coalesce(lines[1], '')), 'pub') THEN 1.0 ELSE 0.0 END
    + 0.3 * CASE WHEN lower(name) LIKE '%cache%' THEN 1.0 ELSE 0.0 END
    + 0.15 * CASE WHEN lower({_return('coalesce(signature, body)')}) IN ('bool', 'boolean') THEN 1.0
        WHEN contains(lower({_return('coalesce(signature, body)')}), 'bool') THEN 0.5 ELSE 0.0 END) / (0.3 + 0.1 + 0.3 + 0.15) AS score
    FROM l WHERE kind IN ('function', 'method')) ORDER BY score DESC, chunk_id LIMIT 20)"""
_STATE = """state AS (SELECT path, max(struct_pack(r := run_id, m := mtime, h := content_hash, c := chunk_ids)) AS s FROM file_state
    WHERE run_id IN (SELECT run_id FROM index_runs WHERE outcome = 'ok') GROUP BY path)"""


def _rank(name: str, source: str) -> str:
    return f"SELECT chunk_id, '{source}' AS source, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM {name}"


def _fuse(*lists: tuple[str, str]) -> str:
    part = "coalesce(max(CASE WHEN source = '{0}' THEN 1.0 / (60 + rank) END), 0)"
    own = ", ".join(f"round(max(CASE WHEN source = '{s}' THEN score END), 6) AS {s}_score" for s in ("text", "semantic", "ast"))
    total = " + ".join(part.format(s) for s in ("text", "semantic", "ast"))
    return f"fused AS (SELECT chunk_id, {total} AS f, {own} FROM ({' UNION ALL '.join(_rank(n, s) for n, s in lists)}) GROUP BY chunk_id ORDER BY f DESC, chunk_id LIMIT 20)"


def _only(hits: str, source: str) -> str:
    own = ", ".join(f"{'round(score, 6)' if s == source else 'CAST(NULL AS DOUBLE)'} AS {s}_score" for s in ("text", "semantic", "ast"))
    return f"SELECT chunk_id, round(score, 6) AS fused_score, {own} FROM {hits}"


_FUSED = "SELECT chunk_id, round(f, 6) AS fused_score, text_score, semantic_score, ast_score FROM fused"
_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1))"
_NAME = "lower(regexp_extract(path, '[^/]*$'))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LANGUAGE = "CASE WHEN " + f"{_NAME} IN {_in(paths.LANGUAGE_NAMES)} THEN 'bash' " + " ".join(f"WHEN {_EXT} IN {_in(es)} THEN '{name}'" for name, es in paths.LANGUAGE_EXTENSIONS.items()) + " END"
_SIGNATURE = f"""CASE WHEN contains(body, '{{') AND {_trim("split_part(body, '{', 1)")} <> '' THEN {_trim("split_part(body, '{', 1)")}
    WHEN contains(body, ':') AND (contains(split_part(body, ':', 1), 'def ') OR contains(split_part(body, ':', 1), 'class ')) THEN {_trim("split_part(body, ':', 1) || ':'")}
    WHEN len(lines) > 0 THEN {_trim("lines[1]")} END"""
_SNIPPET = f"""array_to_string(list_slice(list_filter(lines, lambda x: {_trim('x')} <> '' AND NOT regexp_matches({_trim('x')}, '^(//|#|/\\*|\\*)') AND {_trim('x')} NOT IN ('{{', '}}', '(', ')')), 1, 5), chr(10))"""

_SUMMARIES = f"""{_C}, d AS (SELECT *, {_trim('doc_comment')} AS doc, {_SNIPPET} AS snippet FROM l), sums AS (SELECT id AS chunk_id, concat_ws(chr(10), CASE WHEN name IS NOT NULL THEN kind || ' ' || name END, 'language: ' || language, 'signature: ' || nullif({_trim('signature')}, ''), nullif(CASE WHEN length(doc) > 500 THEN substr(doc, 1, 500) || '...' ELSE doc END, ''), nullif(snippet, '')) AS summary FROM d)"""


def _steps(n: int) -> str:
    """(at, m, c): the generator's state after ``at`` + 1 steps is s * m + c, modulo 2^64."""
    rows, m, c = [], 1, 0
    for at in range(n):
        m, c = m * DummyEmbedder.MULTIPLIER % 2**64, (c * DummyEmbedder.MULTIPLIER + DummyEmbedder.INCREMENT) % 2**64
        rows.append(f"({at}, {m}::HUGEINT, {c}::HUGEINT)")
    return ", ".join(rows)


_EMBED = f"""WITH {_SUMMARIES}, h AS (SELECT chunk_id, hex(encode(summary)) AS x FROM sums),
s AS (SELECT chunk_id, list_reduce(list_prepend(5381::HUGEINT, list_transform(range(0, length(x), 2), lambda i: CAST('0x' || substr(x, i + 1, 2) AS INTEGER)::HUGEINT)), lambda a, b: (a * 33 + b) % 18446744073709551616::HUGEINT) AS s FROM h),
g AS (SELECT chunk_id, element, ((((s // 4294967296) * m) % 4294967296::HUGEINT) * 4294967296::HUGEINT + (s % 4294967296::HUGEINT) * m + c) % 18446744073709551616::HUGEINT AS s FROM s, (VALUES {_steps(64)}) AS k(element, m, c)),
v AS (SELECT chunk_id, element, (CAST(s // 8589934592::HUGEINT AS FLOAT) / CAST(4294967295 AS FLOAT) * CAST(2 AS FLOAT) - CAST(1 AS FLOAT))::DOUBLE AS v FROM g)
SELECT chunk_id, CAST(element AS BIGINT) AS element, round(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS FLOAT)::DOUBLE, 6) + 0.0 AS value FROM v"""

_IN_BRACKETS = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_INNER = r"<[^<>()\[\]{}]*>|\([^<>()\[\]{}]*\)|\[[^<>()\[\]{}]*\]|\{[^<>()\[\]{}]*\}"


def _without_inner(x: str) -> str:
    for _ in range(4):
        x = f"regexp_replace({x}, '{_INNER}', '§', 'g')"
    return x


_TYPE = r"CASE WHEN contains(p, ':') THEN regexp_replace(regexp_replace(trim(substr(p, instr(p, ':') + 1)), '^&+', ''), '^(mut )+', '') ELSE regexp_extract(p, '\S+$') END"
_PARAMS = f"""WITH {_C}, t AS (SELECT id, coalesce(signature, body) AS x FROM l WHERE kind IN ('function', 'method')),
b AS (SELECT id, x, regexp_extract(substr(x, instr(x, '(')), '(?s)^{_IN_BRACKETS}') AS b FROM t),
ps AS (SELECT id, x, list_filter(list_transform(str_split({_without_inner("substr(b, 2, greatest(length(b) - 2, 0))")}, ','), lambda p: trim(p, E' \\t\\n\\r')), lambda p: p <> '') AS ps FROM b),
ty AS (SELECT id, x, list_transform(ps, lambda p: lower(trim({_TYPE}))) AS ty FROM ps),
at_ AS (SELECT id, x, ty, list_position(list_transform(ty, lambda p: p IN {_in(pattern.TYPE_GROUPS[0][1])}), TRUE) AS i FROM ty),
sc AS (SELECT id, CASE WHEN len(ty) < 2 OR coalesce(i, 0) = 0 THEN 0.0 WHEN len(list_filter(list_slice(ty, i + 1, len(ty)), lambda p: p IN {_in(pattern.TYPE_GROUPS[1][1])})) > 0 THEN 1.0 ELSE 0.5 END AS p,
    CASE WHEN lower({_return('x')}) IN ('bool', 'boolean') THEN 1.0 WHEN contains(lower({_return('x')}), 'bool') THEN 0.5 ELSE 0.0 END AS r FROM at_)
SELECT id AS chunk_id, round((0.3 + 0.15 * p + 0.15 * r) / 0.6, 6) AS score FROM sc ORDER BY (0.3 + 0.15 * p + 0.15 * r) / 0.6 DESC, id LIMIT 20"""

SQL: dict[str, str] = {
    "text_regex_search": f"WITH {_C}, {_TEXT} SELECT chunk_id, array_to_string(ms, ',') AS matched_lines, score FROM text_hits",
    "regex_match_lines": r"WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS p FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, " + _LINES.format("p") + f" AS lines FROM s), u AS (SELECT doc_id, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_number FROM l) SELECT doc_id, line_number, line FROM u WHERE regexp_matches(line, '(?i){REGEX}')",
    "match_context": f"WITH {_C}, {_TEXT}, m AS (SELECT chunk_id, ms, unnest(ms) AS k FROM text_hits), w AS (SELECT DISTINCT m.chunk_id, m.ms, l.lines, l.line_start, unnest(generate_series(greatest(0, k - 2), least(k + 2, len(l.lines) - 1))) AS i FROM m JOIN l ON l.id = m.chunk_id) SELECT chunk_id, CAST(line_start + i AS INTEGER) AS line_number, lines[i + 1] AS line, list_contains(ms, i) AS is_match FROM w",
    "postings_build": r"WITH t AS (SELECT id AS chunk_id, unnest(regexp_split_to_array(body, '[^\p{L}\p{N}_]')) AS t FROM (SELECT DISTINCT * FROM chunks)) SELECT lower(t) AS token, chunk_id, count(*) AS freq FROM t WHERE strlen(lower(t)) >= 2 GROUP BY ALL",
    "entry_postings": "WITH e AS (SELECT DISTINCT chunk_id, text_tokens FROM index_entries), t AS (SELECT chunk_id, unnest(text_tokens) AS token FROM e) SELECT token, chunk_id, count(*) AS freq FROM t WHERE token IS NOT NULL GROUP BY ALL",
    "token_search": r"WITH t AS (SELECT id AS chunk_id, lower(unnest(regexp_split_to_array(body, '[^\p{L}\p{N}_]'))) AS token FROM (SELECT DISTINCT * FROM chunks)) SELECT chunk_id, round(sum(CASE token WHEN 'cache' THEN 2 WHEN 'budget' THEN 1 END) / 3.0, 6) AS score FROM t WHERE token IN ('cache', 'budget') GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20",
    "token_search_stored": "WITH t AS (SELECT DISTINCT * FROM postings WHERE freq >= 1) SELECT chunk_id, round(sum(freq * CASE token WHEN 'cache' THEN 2 WHEN 'budget' THEN 1 END) / 3.0, 6) AS score FROM t WHERE token IN ('cache', 'budget') GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20",
    "remove_chunks": "SELECT token, chunk_id, freq FROM postings WHERE chunk_id IN (SELECT id FROM chunks)",
    "upsert_vectors": "WITH e AS (SELECT DISTINCT chunk_id, embedding FROM index_entries), v AS (SELECT DISTINCT chunk_id, embedding FROM vectors WHERE embedding IS NOT NULL) SELECT chunk_id, coalesce(len(embedding), CAST(NULL AS BIGINT)) AS n FROM e UNION ALL SELECT chunk_id, len(embedding) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM e)",
    "knn_exact": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS chunk_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q.e) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM embeddings, q ORDER BY score DESC, chunk_id LIMIT 20",
    "knn_recall": "SELECT TRUE AS enough",
    "knn_threshold": f"WITH {_V} SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM sims ORDER BY score DESC, chunk_id LIMIT 50) WHERE score >= 0.3",
    "knn_batch": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT query_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5",
    "rrf_three_way": f"WITH {_C}, {_TEXT}, {_SEM}, {_AST}, {_fuse(('text_hits', 'text'), ('sem_hits', 'semantic'), ('ast_hits', 'ast'))} {_FUSED}",
    "rrf_two_way": f"WITH {_C}, {_TEXT}, {_SEM}, {_fuse(('text_hits', 'text'), ('sem_hits', 'semantic'))} {_FUSED}",
    "fuse_text_only": f"WITH {_C}, {_TEXT} {_only('text_hits', 'text')}",
    "fuse_semantic_only": f"WITH {_SEM} {_only('sem_hits', 'semantic')}",
    "fuse_ast_only": f"WITH {_C}, {_AST} {_only('ast_hits', 'ast')}",
    "hybrid_search": f"WITH {_C}, {_TEXT}, {_SEM}, ast_hits AS (SELECT id AS chunk_id, (0.3 + 0.3 * CASE WHEN lower(name) = '{REGEX}' THEN 1.0 WHEN contains(lower(name), '{REGEX}') THEN 0.5 ELSE 0.0 END) / 0.6 AS score FROM c WHERE kind IN ('function', 'method') ORDER BY score DESC, chunk_id LIMIT 20), {_fuse(('text_hits', 'text'), ('sem_hits', 'semantic'), ('ast_hits', 'ast'))} SELECT chunk_id, round(f, 6) AS fused_score, file_path, kind, name FROM fused JOIN c ON c.id = fused.chunk_id",
    "chunk_fallback": r"WITH s AS (SELECT file_path, regexp_split_to_array(text, '\r?\n') AS p FROM documents WHERE text IS NOT NULL), l AS (SELECT file_path, " + _LINES.format("p") + " AS lines FROM s), b AS (SELECT *, unnest(generate_series(0, len(lines) - 1, 50)) AS a FROM l WHERE len(lines) > 0), z AS (SELECT *, least(a + 50, len(lines)) AS z FROM b), y AS (SELECT *, array_to_string(list_slice(lines, a + 1, z), chr(10)) AS body, CAST(coalesce(list_sum(list_transform(list_slice(lines, 1, a), lambda x: strlen(x) + 1)), 0) AS BIGINT) AS byte_start FROM z) SELECT file_path, regexp_extract(file_path, '[^/]*$') || ':L' || (a + 1) || '-L' || z AS name, body, byte_start, byte_start + strlen(body) AS byte_end, CAST(a AS INTEGER) AS line_start, CAST(z AS INTEGER) AS line_end FROM y",
    "signature_extract": f"WITH {_C} SELECT id, nullif({_SIGNATURE}, '') AS signature FROM l",
    "summary_build": f"WITH {_SUMMARIES} SELECT chunk_id, summary FROM sums",
    "line_counts": r"WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS p FROM documents) SELECT doc_id, len(" + _LINES.format("p") + ") AS lines FROM s",
    "language_detect": f"SELECT DISTINCT path, {_LANGUAGE} AS language FROM scan_entries",
    "source_filter": f"SELECT path, size FROM (SELECT path, max(struct_pack(a := seen_at, b := modified, c := size)).c AS size FROM scan_entries GROUP BY path) WHERE size <= 10485760 AND ({_NAME} IN {_in(paths.SOURCE_NAMES)} OR {_EXT} IN {_in(paths.SOURCE_EXTENSIONS)})",
    "watch_filter": f"SELECT DISTINCT path FROM scan_entries WHERE regexp_extract(path, '[^/]\\.([^./]*)$', 1) IN {_in(paths.WATCHED_EXTENSIONS)}",
    "exclude_filter": r"SELECT doc_id, file_path FROM documents WHERE regexp_matches(file_path, '(^|/)([^/]*\.min\.js|[^/]*\.min\.css|[^/]*\.lock|package-lock\.json|yarn\.lock)(/|$)')",
    "binary_detect": "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN FALSE ELSE (length(substr(text, 1, 8192)) - length(replace(substr(text, 1, 8192), chr(0), ''))) * 100 > least(strlen(text), 8192) END AS is_binary FROM documents",
    "latest_scan": "SELECT path, max(struct_pack(a := seen_at, b := modified, c := size)).c AS size, epoch_us(max(seen_at)) AS seen_us FROM scan_entries GROUP BY path",
    "ast_pattern_search": f"WITH {_C}, {_AST} SELECT chunk_id, round(score, 6) AS score FROM ast_hits",
    "ast_struct_search": "SELECT id AS chunk_id, round((0.3 + 0.3 * CASE WHEN lower(name) LIKE '%tree' THEN 1.0 WHEN contains(lower(name), 'tree') THEN 0.5 ELSE 0.0 END) / 0.6, 6) AS score FROM (SELECT DISTINCT * FROM chunks) WHERE kind = 'struct' ORDER BY score DESC, chunk_id LIMIT 20",
    "ast_params_search": _PARAMS,
    "dummy_embed": _EMBED,
    "return_types": f"SELECT id, {_return('coalesce(signature, body)')} AS return_type FROM (SELECT DISTINCT * FROM chunks)",
    "wildcard_match": "SELECT id, name FROM (SELECT DISTINCT * FROM chunks) WHERE name ILIKE '%tree%'",
    "fuzzy_type_match": f"SELECT id, return_type FROM (SELECT id, {_return('signature')} AS return_type FROM (SELECT DISTINCT * FROM chunks)) WHERE lower({_trim('return_type')}) IN {_in(pattern.TYPE_GROUPS[1][1])}",
    "incremental_diff": f"WITH {_STATE}, t AS (SELECT path, max(struct_pack(a := seen_at, b := modified, c := size)).b AS mtime FROM scan_entries GROUP BY path), n AS (SELECT d.file_path AS path, sha256(d.text) AS h, t.mtime FROM documents d LEFT JOIN t ON t.path = d.file_path) SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN s.path IS NOT NULL AND coalesce(n.mtime = s.s.m OR n.h = lower(s.s.h), n.mtime = s.s.m, n.h = lower(s.s.h), FALSE) THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN state s ON s.path = n.path",
    "chunk_ids_to_remove": f"WITH {_STATE} SELECT unnest(s.c) AS chunk_id FROM state WHERE path NOT IN (SELECT file_path FROM documents)",
    "apply_deletions": f"WITH {_STATE} SELECT path, lower(s.h) AS content_hash FROM state WHERE path IN (SELECT file_path FROM documents)",
    "update_state": f"WITH {_STATE}, n AS (SELECT file_path, count(DISTINCT id) AS n FROM chunks GROUP BY ALL) SELECT d.file_path AS path, sha256(d.text) AS content_hash, coalesce(n.n, 0) AS n FROM documents d LEFT JOIN n USING (file_path) UNION ALL SELECT path, lower(s.h), coalesce(len(s.c), -1) FROM state WHERE path NOT IN (SELECT file_path FROM documents)",
    "event_dedup": "SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS op FROM events GROUP BY user_id",
    "index_status": "SELECT count(DISTINCT id) AS chunk_count, count(DISTINCT file_path) AS files, (SELECT max(len(embedding)) FROM vectors) AS embedding_dim FROM chunks",
    "p4_found": """
WITH states AS (SELECT path, max(struct_pack(r := run_id, h := coalesce(lower(content_hash), ''))).h AS h FROM file_state
    WHERE run_id IN (SELECT run_id FROM index_runs WHERE outcome = 'ok') GROUP BY path),
now_ AS (SELECT file_path, sha256(text) AS h FROM documents WHERE file_path IS NOT NULL)
SELECT coalesce(s.path, n.file_path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS status
FROM now_ n FULL JOIN states s ON s.path = n.file_path
WHERE s.path IS NULL OR n.file_path IS NULL OR n.h IS NULL OR s.h = '' OR n.h <> s.h""",
}
