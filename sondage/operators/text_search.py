"""Regular-expression search in lines of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.errors import InvalidPattern
from sondage.functions.lines import lines_of

TOP_K, CONTEXT_LINES = 20, 2


def checked(spark: SparkSession, pattern: str, case_sensitive: bool = False) -> str:
    """The pattern with its flags; raises on the driver if it does not compile."""
    flagged = pattern if case_sensitive else f"(?iu){pattern}"
    try:
        spark._jvm.java.util.regex.Pattern.compile(flagged)
    except Exception as e:
        raise InvalidPattern(pattern) from e
    return flagged


def _matched(lines: Column, pattern: str) -> Column:
    """The numbers of matching lines, from 0."""
    marked = F.transform(lines, lambda line, i: F.when(line.rlike(pattern), i))
    return F.filter(marked, lambda i: i.isNotNull())


#: What a pattern may hold if a text without a match is to have no line with one: no lookaround, no input anchors, nothing possessive.
_LINEWISE = re.compile(r"\(\?|\\[AzZGQEBk\d]|[*+?}]\+")


def _may_match(body: Column, pattern: str, flagged: str) -> Column | None:
    """A quick test of a whole text before it is split: false only where no line matches. None if there is none."""
    return None if _LINEWISE.search(pattern) else body.rlike(f"(?m){flagged}")


def regex_search(chunks: DataFrame, pattern: str, top_k: int = TOP_K, case_sensitive: bool = False, id_column: str = "id", body_column: str = "body") -> DataFrame:
    """(chunk_id, matched_lines, score): best chunks by matching lines and their density, ties by id.

    Only id and body are read, and no body is moved: repeated rows of a chunk meet as hits, of which the best counts. The
    top is kept per task before one task merges them.
    """
    rx = checked(chunks.sparkSession, pattern, case_sensitive)
    body = F.col(body_column)
    quick = _may_match(body, pattern, rx)
    rows = (chunks if quick is None else chunks.where(quick)).select(F.col(id_column).alias("chunk_id"), lines_of(body).alias("lines"))
    found = rows.select("chunk_id", F.size("lines").alias("n"), _matched(F.col("lines"), rx).alias("matched_lines"))
    m = F.size("matched_lines").cast("double")
    score = m + F.lit(10.0) * m / F.greatest(F.col("n"), F.lit(1))
    if quick is None:
        found = found.where(F.size("matched_lines") > 0)
    hits = found.groupBy("chunk_id").agg(F.max(F.struct(score.alias("score"), "matched_lines")).alias("hit"))
    return hits.where(F.size("hit.matched_lines") > 0).select("chunk_id", "hit.matched_lines", "hit.score").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def matching_lines(texts: DataFrame, pattern: str, case_sensitive: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line_number, line): every matching line, numbered from 0. No index needed, no shuffle."""
    rx = checked(texts.sparkSession, pattern, case_sensitive)
    rows = texts.select(F.col(id_column).alias(id_column), F.posexplode(lines_of(F.col(text_column))).alias("line_number", "line"))
    return rows.where(F.col("line").rlike(rx))


def match_context(matches: DataFrame, chunks: DataFrame, context_lines: int = CONTEXT_LINES, id_column: str = "id", body_column: str = "body", start_column: str | None = "line_start") -> DataFrame:
    """(chunk_id, line_number, line, is_match): matches with the lines around them, each line once, numbered in the file."""
    start = F.col(start_column) if start_column else F.lit(0)
    bodies = chunks.select(F.col(id_column).alias("chunk_id"), lines_of(F.col(body_column)).alias("lines"), start.alias("start"))
    rows = matches.select("chunk_id", "matched_lines").join(bodies, "chunk_id").dropDuplicates(["chunk_id"])
    near = F.array_distinct(F.flatten(F.transform("matched_lines", lambda m: F.sequence(F.greatest(F.lit(0), m - context_lines), F.least(m + context_lines, F.size("lines") - 1)))))
    out = rows.select("chunk_id", "start", "lines", "matched_lines", F.explode(near).alias("i"))
    return out.select("chunk_id", (F.col("start") + F.col("i")).alias("line_number"), F.col("lines")[F.col("i")].alias("line"), F.array_contains("matched_lines", F.col("i")).alias("is_match"))
