"""Tokens of the inverted index."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = regex.compile(r"[^\p{Alphabetic}\p{N}_]")
#: Shortest token, in UTF-8 bytes.
SHORTEST = 2


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two bytes or more, in order, with repetition."""
    parts = F.transform(F.split(text, "[^\\p{IsAlphabetic}\\p{N}_]"), F.lower)
    return F.filter(parts, lambda t: F.octet_length(t) >= SHORTEST)


def query_tokens(text: str) -> list[str]:
    """The same rule on the driver, for a query."""
    return [t for t in (p.lower() for p in _SPLIT.split(text)) if len(t.encode()) >= SHORTEST]
