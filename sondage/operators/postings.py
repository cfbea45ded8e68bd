"""The inverted index and search in it."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.tokens import query_tokens, tokens_of

TOP_K = 20


def build_postings(chunks: DataFrame, id_column: str = "id", text_column: str = "body") -> DataFrame:
    """(token, chunk_id, freq): tokens are counted in each task before the shuffle on (token, chunk_id)."""
    rows = chunks.select(F.col(id_column).alias("chunk_id"), F.explode(tokens_of(F.col(text_column))).alias("token"))
    return rows.groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("freq"))


def entry_postings(entries: DataFrame) -> DataFrame:
    """The same from index entries (chunk_id, text_tokens)."""
    rows = entries.select("chunk_id", F.explode("text_tokens").alias("token")).where("token is not null")
    return rows.groupBy("token", "chunk_id").agg(F.count(F.lit(1)).alias("freq"))


def token_search(postings: DataFrame, query: str, top_k: int = TOP_K) -> DataFrame:
    """(chunk_id, score): summed freq of the query's tokens, repeated ones repeatedly, over their number.

    The tokens become a filter that reaches the scan, where row groups sorted by token are skipped; no join.
    """
    asked = Counter(query_tokens(query))
    if not asked:
        return postings.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    hits = postings.where(F.col("token").isin(*asked)).withColumn("times", times[F.col("token")])
    score = F.sum(F.col("freq") * F.col("times")) / F.lit(float(sum(asked.values())))
    return hits.groupBy("chunk_id").agg(score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def remove_chunks(table: DataFrame, removed: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """``table`` without the rows of ``removed`` (chunk_id). Catalyst broadcasts the ids only while they are few."""
    return table.join(removed.select(F.col("chunk_id").alias(id_column)), id_column, "left_anti")


def upsert_vectors(vectors: DataFrame, added: DataFrame) -> DataFrame:
    """Vectors with ``added`` in place of what they had under the same ids."""
    return remove_chunks(vectors, added.select("chunk_id")).unionByName(added.select("chunk_id", "embedding"))


def add_postings(postings: DataFrame, added: DataFrame) -> DataFrame:
    """Postings with the freqs of ``added`` summed in."""
    return postings.select("token", "chunk_id", "freq").unionByName(added.select("token", "chunk_id", "freq")).groupBy("token", "chunk_id").agg(F.sum("freq").alias("freq"))
