"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K, TOP_K = 60, 20


def _ranked(hits: DataFrame | None, source: str, like: DataFrame) -> DataFrame:
    """A list as (chunk_id, source, score, rank, matched_lines); rank from 0 by falling score, ties by id."""
    if hits is None:
        hits = like.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    lines = F.col("matched_lines").cast("array<int>") if "matched_lines" in hits.columns else F.lit(None).cast("array<int>")
    order = Window.orderBy(F.desc("score"), "chunk_id")
    return hits.select("chunk_id", F.lit(source).alias("source"), F.col("score").cast("double").alias("score"), (F.row_number().over(order) - 1).alias("rank"), lines.alias("matched_lines"))


def rrf_fuse(text: DataFrame, semantic: DataFrame | None = None, ast: DataFrame | None = None, k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of up to three lists: 1 / (k + rank + 1) each, summed per chunk.

    (chunk_id, fused_score, text_score, semantic_score, ast_score, matched_lines); a list's score is null where it does
    not hold the chunk. The lists are results of top-k searches, so that ranking one in a single task is bounded.
    """
    lists = [_ranked(h, s, text) for h, s in ((text, "text"), (semantic, "semantic"), (ast, "ast"))]
    rows = lists[0].unionByName(lists[1]).unionByName(lists[2]).withColumn("part", F.lit(1.0) / (F.lit(float(k)) + F.col("rank") + 1))

    def of(column: str, source: str):
        return F.max(F.when(F.col("source") == source, F.col(column)))

    fused = sum((F.coalesce(of("part", s), F.lit(0.0)) for s in ("semantic", "ast")), F.coalesce(of("part", "text"), F.lit(0.0)))
    out = rows.groupBy("chunk_id").agg(
        fused.alias("fused_score"),
        of("score", "text").alias("text_score"),
        of("score", "semantic").alias("semantic_score"),
        of("score", "ast").alias("ast_score"),
        F.coalesce(F.max("matched_lines"), F.array().cast("array<int>")).alias("matched_lines"),
    )
    return out.orderBy(F.desc("fused_score"), "chunk_id").limit(top_k)


def fuse_only(hits: DataFrame, source: str, top_k: int = TOP_K) -> DataFrame:
    """One list in the shape of a fused one: the fused score is its own."""
    lines = F.col("matched_lines").cast("array<int>") if "matched_lines" in hits.columns else F.array().cast("array<int>")
    score = F.col("score").cast("double")
    own = [(score if s == source else F.lit(None).cast("double")).alias(f"{s}_score") for s in ("text", "semantic", "ast")]
    return hits.select("chunk_id", score.alias("fused_score"), *own, lines.alias("matched_lines")).orderBy(F.desc("fused_score"), "chunk_id").limit(top_k)
