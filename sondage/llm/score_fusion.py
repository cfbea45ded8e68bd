"""One ranking from several differently-scaled scores.

Each score of a query is standardised by median and median absolute deviation (MAD), squashed by the logistic function
and combined by a weighted geometric mean, so no score rules by its range and no outlier by its size.

Cases: NaN and infinities of the wrong kind: NaN is no score; +-Infinity stays, the clip bounds it. A missing score
counts as the lowest possible one. A repeated row counts once; of different scores of one (query, item) the greatest
holds. With a MAD of 0 the mean absolute deviation takes its place; if that is 0 too, every value is the middle (0.5).
Ties in the fused score are ordered by the item's id. Null ids are dropped. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.ranking import global_rank, median_of, per_part

SCORES = ("text_score", "semantic_score", "ast_score")
#: Standardised values beyond +-CLIP are outliers and count as +-CLIP; a missing score counts as -CLIP.
CLIP = 12.0


def fuse_scores(results: DataFrame, scores: tuple[str, ...] = SCORES, weights: tuple[float, ...] | None = None, top: int = 10) -> DataFrame:
    """(query_id, chunk_id, fused, rank, group_size, leads, reach): one order per query.

    ``leads`` is the number of scores by which fewer than ``top`` items of the query are strictly ahead; ``reach`` is
    the fused score of the item ranked ``len(scores) * (top - 1) + 1``. All medians are exact; no step puts a whole
    query into one task.
    """
    weights = weights or tuple(1.0 for _ in scores)
    share = [x / sum(weights) for x in weights]
    key = ["query_id", "kind"]
    once = (
        results.where("query_id is not null and chunk_id is not null")
        .groupBy("query_id", "chunk_id")
        .agg(*[F.max(F.when(~F.isnan(s), F.col(s)).cast("double")).alias(s) for s in scores])
    )
    long = once.select("query_id", "chunk_id", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(s).alias("score")) for i, s in enumerate(scores)])).alias("x"))
    long = long.select("query_id", "chunk_id", "x.kind", "x.score")

    given = long.where("score is not null")
    ranked, parts = global_rank(given, key, [F.desc("score"), F.col("chunk_id")])
    centre = ranked.groupBy(*key).agg(median_of(ranked, key, "score").alias("mid"), F.max(F.when(F.col("rank") == top, F.col("score"))).alias("last_lead"))
    off = (
        ranked.join(per_part(parts, centre, key), ["_pid", *key])
        .withColumn("off", F.abs(F.col("score") - F.col("mid")))
        .withColumn("lead", (F.col("last_lead").isNull() | (F.col("score") >= F.col("last_lead"))).cast("int"))
        .select(*key, "chunk_id", "score", "mid", "off", "lead")
    )
    ranked, parts = global_rank(off, key, [F.col("off"), F.col("chunk_id")])
    spread = ranked.groupBy(*key).agg(median_of(ranked, key, "off").alias("mad"), F.avg("off").alias("mean_off"))
    scale = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).when(F.col("mean_off") > 0, F.col("mean_off") * 1.2533)
    z = F.when(scale.isNull() | F.isnan(scale), F.lit(0.0)).otherwise((F.col("score") - F.col("mid")) / scale)
    bounded = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))
    logged = F.lit(-1.0) * F.log1p(F.exp(-bounded))
    weight = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("kind") + 1)
    lowest = -math.log1p(math.exp(CLIP))
    squashed = ranked.join(per_part(parts, spread, key), ["_pid", *key]).select("query_id", "chunk_id", "lead", (weight * logged).alias("part"), weight.alias("given"))
    missing = long.where("score is null").select("query_id", "chunk_id", F.lit(0).alias("lead"), (weight * lowest).alias("part"), weight.alias("given"))
    fused = squashed.unionByName(missing).groupBy("query_id", "chunk_id").agg(F.round(F.exp(F.sum("part")), 9).alias("fused"), F.sum("lead").cast("int").alias("leads"))

    order, parts = global_rank(fused, ["query_id"], [F.desc("fused"), F.col("chunk_id")])
    at = order.groupBy("query_id").agg(F.max(F.when(F.col("rank") == len(scores) * (top - 1) + 1, F.col("fused"))).alias("reach"))
    return order.join(per_part(parts, at, ["query_id"]), ["_pid", "query_id"]).select("query_id", "chunk_id", "fused", "rank", "group_size", "leads", "reach")


def agreed_top(fused: DataFrame, scores: int = len(SCORES)) -> DataFrame:
    """(query_id, chunk_id): items at the top by all accounts.

    The fused score grows with each score, so an item with fewer than ten items ahead by each of three scores has at
    most 27 ahead in the fused order: the operator's first ranks (``reach``) give the candidates, ``leads`` is the exact
    check that follows. It is what a case is by definition; the candidates hold every case.
    """
    near = F.col("reach").isNull() | (F.col("fused") >= F.col("reach"))
    return fused.where(near & (F.col("leads") == scores)).select("query_id", "chunk_id")
