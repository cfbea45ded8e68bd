"""How distinctive a term is per record: log-likelihood ratio of a two-by-two contingency table.

For term t and record r the table holds the count of t in r, the other counts of r, the count of t elsewhere and
everything else. ``llr`` is Dunning's G2 with the sign of the association: positive where r holds more of t than the
rest of the collection does.

Cases: null or empty token, token with other characters than a-z, 0-9 and _, null freq, freq below 1 and a record not
in ``records`` do not count; a repeated row counts once, of different freqs of one (token, record) the greatest holds; empty tables
give no rows; extra columns are ignored. Equal counts give equal scores, so ties stay ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondage.storage import written

#: A token on more than 1 / HEAVY_SHARE of all rows is heavy; there are never more than HEAVY_SHARE of them.
HEAVY_SHARE = 2000


def clean_postings(postings: DataFrame, records: DataFrame, record_id: str = "id") -> DataFrame:
    """(token, chunk_id, freq, record_total): usable rows, once each.

    Repeated rows meet in partial aggregates before the shuffle on (chunk_id, token), so neither a group of copies nor a
    record with very many terms makes a hot task; the totals join is a plain one that adaptive execution may split.
    """
    usable = postings.where(F.col("token").rlike("^[a-z0-9_]+$") & (F.col("freq") >= 1) & F.col("chunk_id").isNotNull())
    rows = usable.select("token", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("freq").cast("bigint").alias("freq"))
    terms = rows.groupBy("chunk_id", "token").agg(F.max("freq").alias("freq"))
    known = records.select(F.col(record_id).cast("bigint").alias("chunk_id")).where("chunk_id is not null")
    totals = terms.groupBy("chunk_id").agg(F.sum("freq").alias("record_total")).join(known, "chunk_id", "left_semi")
    return terms.join(totals.hint("shuffle_hash"), "chunk_id").select("token", "chunk_id", "freq", "record_total")


def _g2(k11: Column, row: Column, col: Column, n: Column) -> Column:
    """Signed G2 of the table with first cell k11, first row sum, first column sum and grand total."""

    def part(k: Column, r: Column, c: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (r * c))).otherwise(F.lit(0.0))

    k12, k21 = row - k11, col - k11
    k22 = n - row - k21
    g2 = F.lit(2.0) * (part(k11, row, col) + part(k12, row, n - col) + part(k21, n - row, col) + part(k22, n - row, n - col))
    return F.when(k11 * n >= row * col, g2).otherwise(-g2)


def term_scores(postings: DataFrame, records: DataFrame, record_id: str = "id") -> DataFrame:
    """(chunk_id, token, freq, df, cf, llr) for every usable row.

    The cleaned rows are written once. Token totals are pre-aggregated before their shuffle. Totals of heavy tokens, at
    most HEAVY_SHARE rows whatever the input, are broadcast, so that no hot token meets in one task; the others, none
    with more than 1 / HEAVY_SHARE of the rows, are joined by a shuffle.
    """
    rows = written(clean_postings(postings, records, record_id), "terms")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("t")).first()
    totals = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("freq").alias("cf"))
    n = F.lit(float(size.t or 0))
    heavy = written(totals.where(F.col("df") * HEAVY_SHARE > size.n), "heavy")
    hot = rows.join(F.broadcast(heavy), "token")
    rest = rows.join(F.broadcast(heavy.select("token")), "token", "left_anti")
    light = totals.where(F.col("df") * HEAVY_SHARE <= size.n)
    joined = hot.unionByName(rest.join(light, "token"))
    d = [F.col(c).cast("double") for c in ("freq", "record_total", "cf")]
    return joined.select("chunk_id", "token", "freq", "df", "cf", _g2(d[0], d[1], d[2], n).alias("llr"))


def most_distinctive(scores: DataFrame, k: int = 10) -> DataFrame:
    """(chunk_id, token, llr, rank): the ``k`` most distinctive terms of every record, ties by token.

    The cut is made in every task before the shuffle, so a record with very many terms sends no more than ``k`` a task.
    """
    best = Window.partitionBy("chunk_id").orderBy(F.desc("llr"), "token")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("chunk_id", "token", "llr", "rank")


def rare_shared_terms(scores: DataFrame) -> DataFrame:
    """(chunk_id, token): terms with freq of 3 or more that 2 to 6 records hold, the most distinctive first.

    The score orders the terms and excludes none: in a record with much of all counts a rare term may score below 0.
    """
    cases = scores.where((F.col("freq") >= 3) & F.col("df").between(2, 6))
    return cases.orderBy(F.desc("llr"), "chunk_id", "token").select("chunk_id", "token")
