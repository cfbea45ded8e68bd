"""Summaries of chunks: the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.lines import lines_of

SNIPPET_LINES, DOC_LENGTH = 5, 500


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def body_snippet(body: Column, lines: int = SNIPPET_LINES) -> Column:
    """The first lines that are neither blank nor look like comments nor are a lone bracket, as they are."""

    def tells(line: Column) -> Column:
        t = trimmed(line)
        return (t != "") & ~t.rlike(r"^(?://|#|/\*|\*)") & ~t.isin("{", "}", "(", ")")

    return F.array_join(F.slice(F.filter(lines_of(body), tells), 1, lines), "\n")


def signature(body: Column) -> Column:
    """The text before the first brace; else, of a def or class, through the first colon; else the first line."""
    before_brace = trimmed(F.substring_index(body, "{", 1))
    head = F.substring_index(body, ":", 1)
    first = trimmed(F.element_at(lines_of(body), 1))
    by_colon = F.instr(body, ":") > 0
    text = (
        F.when((F.instr(body, "{") > 0) & (before_brace != ""), before_brace)
        .when(by_colon & (F.contains(head, F.lit("def ")) | F.contains(head, F.lit("class "))), trimmed(F.concat(head, F.lit(":"))))
        .when(F.size(lines_of(body)) > 0, first)
    )
    return F.when(text != "", text)


def summary(chunks: DataFrame) -> Column:
    """Kind and name, language, signature, documentation and snippet, each on its line, what is missing left out."""
    doc = trimmed(F.col("doc_comment"))
    cut = F.when(F.length(doc) > DOC_LENGTH, F.concat(F.substring(doc, 1, DOC_LENGTH), F.lit("..."))).otherwise(doc)
    parts = [
        F.when(F.col("name").isNotNull(), F.concat_ws(" ", "kind", "name")),
        F.concat(F.lit("language: "), F.col("language")),
        F.concat(F.lit("signature: "), F.when(trimmed(F.col("signature")) != "", trimmed(F.col("signature")))),
        F.when(doc != "", cut),
        F.when(body_snippet(F.col("body")) != "", body_snippet(F.col("body"))),
    ]
    return F.concat_ws("\n", *parts)


def summaries(chunks: DataFrame) -> DataFrame:
    """(chunk_id, summary) of every chunk."""
    return chunks.select(F.col("id").alias("chunk_id"), summary(chunks).alias("summary"))
