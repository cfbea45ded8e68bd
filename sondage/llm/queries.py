"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import corpus_encoding, documented_functions, handwritten, parse_faults, score_fusion, source_mixing, term_distinctiveness, vector_neighbours, visual_form
from sondage.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "documents")).select("doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_distinctiveness.rare_shared_terms(term_distinctiveness.term_scores(table(spark, d, "postings"), table(spark, d, "chunks")))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every chunk with its score."""
    scores = term_distinctiveness.term_scores(table(spark, d, "postings"), table(spark, d, "chunks"))
    llr = F.round("llr", 4)
    return scores.select("chunk_id", "token", "freq", "df", F.when(llr != 0, llr).otherwise(0.0).alias("llr"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten most distinctive terms of every chunk."""
    scores = term_distinctiveness.term_scores(table(spark, d, "postings"), table(spark, d, "chunks"))
    return term_distinctiveness.most_distinctive(scores.withColumn("llr", F.round("llr", 4)), 10).withColumn("llr", F.col("llr") + 0.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_faults.parse_faults(table(spark, d, "documents")).where("fault is not null").select("doc_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_faults.fault_rates(parse_faults.parse_faults(table(spark, d, "documents"), ("project",)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return score_fusion.agreed_top(score_fusion.fuse_scores(table(spark, d, "fused_results")))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The fused order of every query."""
    return score_fusion.fuse_scores(table(spark, d, "fused_results")).select("query_id", "chunk_id", F.round("fused", 6).alias("fused"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions.documented_functions(table(spark, d, "chunks"), table(spark, d, "documents")).select("id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs themselves: code and documentation."""
    keep = ("id", "language", "signature", "body")
    return documented_functions.documented_functions(table(spark, d, "chunks"), table(spark, d, "documents"), keep)


def p6_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of all nine languages, delimited in the files themselves."""
    return documented_functions.delimited_functions(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.similar_pairs(table(spark, d, "vectors"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every fiftieth row, against all rows, by walking the graph."""
    return vector_neighbours.neighbours(table(spark, d, "vectors"), k=5, every=50)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_encoding.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.shares_reached(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.same_look_pairs(visual_form.form_keys(table(spark, d, "documents")))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """All texts in their consistent form."""
    return visual_form.consistent_texts(table(spark, d, "documents"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a file is no hand-written source."""
    return handwritten.not_handwritten(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_scores, p2_terms, p3_found, p3_rates, p5_found, p5_ranking, p6_found, p6_pairs, p6_functions, p7_found, p7_neighbours, p8_ids, p9_mix, p9_shares, p10_found, p10_forms)}

_CLEAN = """
WITH rows_ AS (SELECT DISTINCT p.token, p.chunk_id, p.freq FROM postings p
  WHERE regexp_full_match(p.token, '[a-z0-9_]+') AND p.freq >= 1 AND p.chunk_id IN (SELECT id FROM chunks)),
terms AS (SELECT chunk_id, token, max(freq) AS freq FROM rows_ GROUP BY ALL),
totals AS (SELECT token, count(*) AS df, CAST(sum(freq) AS BIGINT) AS cf FROM terms GROUP BY ALL)
"""

_CELL = "CASE WHEN {0} > 0 THEN {0} * ln({0} * t.n / ({1} * {2})) ELSE 0 END"
_G2 = " + ".join(_CELL.format(*x) for x in (("a", "r", "c"), ("(r - a)", "r", "(t.n - c)"), ("(c - a)", "(t.n - r)", "c"), ("(t.n - r - c + a)", "(t.n - r)", "(t.n - c)")))

_SCORES = f"""x AS (SELECT chunk_id, token, freq, df, freq::DOUBLE AS a, sum(freq) OVER (PARTITION BY chunk_id)::DOUBLE AS r, cf::DOUBLE AS c FROM terms JOIN totals USING (token)),
t AS (SELECT sum(freq)::DOUBLE AS n FROM terms),
scored AS (SELECT chunk_id, token, freq, df, round(CASE WHEN a * t.n >= r * c THEN 1 ELSE -1 END * 2.0 * ({_G2}), 4) + 0.0 AS llr FROM x, t)"""



def _translated() -> tuple[str, str, str]:
    """Characters that go, and those that become others, of the scripts with look-alike letters: for a plain SQL rule."""
    gone, one, other = "", "", ""
    for code in (*range(0xA0, 0x590), *range(0x13A0, 0x13F6), *range(0x2C80, 0x2CF4), *range(0xA4D0, 0xA4F8), *range(0x1F00, 0x2070), *range(0x2160, 0x2180), 0x3000, 0xFEFF, *range(0xFE00, 0xFE10), *range(0xFF01, 0xFF5F)):
        ch = chr(code)
        if unicodedata.combining(ch):
            continue
        seen = visual_form.one_form("x" + ch)[1:]
        if not seen:
            gone += ch
        elif seen != ch and len(seen) == 1:
            one, other = one + ch, other + seen
    return gone, one, other


_GONE, _FROM, _TO = (x.replace("'", "''") for x in _translated())
_LOOK = f"nfc_normalize(translate(nfc_normalize(regexp_replace(text, '[{_GONE}]', '', 'g')), '{_FROM}', '{_TO}'))"

SQL: dict[str, str] = {
    "p2_scores": f"{_CLEAN}, {_SCORES} SELECT chunk_id, token, freq, df, llr FROM scored",
    "p2_terms": f"{_CLEAN}, {_SCORES} SELECT chunk_id, token, llr, row_number() OVER (PARTITION BY chunk_id ORDER BY llr DESC, token) AS rank FROM scored QUALIFY rank <= 10",
    "p7_found": """WITH v AS (SELECT chunk_id, min(embedding) AS e FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
u AS (SELECT chunk_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])))::DOUBLE[64] AS e FROM v)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM u a JOIN u b ON a.chunk_id < b.chunk_id WHERE array_inner_product(a.e, b.e) >= 0.9""",
    "p10_found": f"""WITH f AS (SELECT DISTINCT doc_id, text, {_LOOK} AS look FROM documents WHERE doc_id IS NOT NULL AND trim(text, E' \\t\\n\\r') <> '')
SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b USING (look) WHERE a.doc_id <> b.doc_id AND a.text <> b.text""",
    "p5_ranking": """
WITH once AS (SELECT query_id, chunk_id, unnest([{k: 0, s: a}, {k: 1, s: b}, {k: 2, s: c}], recursive := true) FROM (SELECT query_id, chunk_id,
    max(CASE WHEN NOT isnan(text_score) THEN text_score END) AS a, max(CASE WHEN NOT isnan(semantic_score) THEN semantic_score END) AS b,
    max(CASE WHEN NOT isnan(ast_score) THEN ast_score END) AS c FROM fused_results GROUP BY ALL)),
m AS (SELECT query_id, k, median(s) AS mid FROM once GROUP BY ALL),
o AS (SELECT *, abs(s - mid) AS off FROM once JOIN m USING (query_id, k)),
d AS (SELECT query_id, k, median(off) AS mad, avg(off) AS mean_off FROM o GROUP BY ALL),
z AS (SELECT query_id, chunk_id, CASE WHEN s IS NULL THEN -12.0 WHEN mad > 0 THEN (s - mid) / (mad * 1.4826) WHEN mean_off > 0 THEN (s - mid) / (mean_off * 1.2533) ELSE 0 END AS z FROM o JOIN d USING (query_id, k))
SELECT query_id, chunk_id, round(exp(sum(-ln(1 + exp(-greatest(-12.0, least(12.0, z)))) / 3)), 6) AS fused FROM z GROUP BY ALL""",
    "p2_found": _CLEAN + "SELECT chunk_id, token FROM terms JOIN totals USING (token) WHERE freq >= 3 AND df BETWEEN 2 AND 6",
    "p5_found": """
WITH once AS (SELECT query_id, chunk_id,
    max(CASE WHEN NOT isnan(text_score) THEN text_score END) AS a,
    max(CASE WHEN NOT isnan(semantic_score) THEN semantic_score END) AS b,
    max(CASE WHEN NOT isnan(ast_score) THEN ast_score END) AS c FROM fused_results GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) AS ra,
    rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) AS rb,
    rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) AS rc FROM once)
SELECT query_id, chunk_id FROM ranked WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND ra <= 10 AND rb <= 10 AND rc <= 10""",
}
