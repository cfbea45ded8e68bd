"""Lines of a text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; a final line end opens no further line. Null for null."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """The number of lines, at least 0; null for null."""
    return F.when(text.isNotNull(), F.size(lines_of(text)))


def split_lines(text: str | None) -> list[str]:
    """The same rule on the driver and in Python workers: lines end at a line feed, with or without a carriage return."""
    lines = re.split("\r?\n", text or "")
    return lines[:-1] if lines[-1] == "" else lines
