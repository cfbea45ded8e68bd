"""Results as text; for the few rows of a top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sondage.functions.lines import split_lines

_BOLD, _CYAN, _DIM, _END = "\033[1m", "\033[36m", "\033[2m", "\033[0m"


def as_json(results: DataFrame) -> list[str]:
    """One JSON object per row."""
    return [r.value for r in results.select(F.to_json(F.struct("*")).alias("value")).collect()]


def _head(row) -> list[str]:
    return [row.signature] if row.signature else split_lines(row.body)[:3]


def coloured(results: DataFrame) -> str:
    """For a terminal: file, lines from 1, score, signature or the first three lines."""
    out = []
    for n, r in enumerate(results.collect(), 1):
        out.append(f"{_BOLD}[{n}]{_END} {_CYAN}{r.file_path}{_END}:{r.line_start + 1}-{r.line_end} {_DIM}({r.kind}, score {r.fused_score:.4f}){_END}")
        out += [f"    {line}" for line in _head(r)]
    return "\n".join(out) if out else "No results found."


def block(rows: list[Row], seconds: float = 0.0) -> str:
    """For a tool's output: every row of a result with its signature and the first five lines."""
    if not rows:
        return "No results found."
    out = [f"{len(rows)} results in {seconds * 1000:.0f} ms"]
    for n, r in enumerate(rows, 1):
        out.append(f"\n[{n}] {r.name or '-'} ({r.kind}), {r.file_path} lines {r.line_start + 1}-{r.line_end}, score {r.fused_score:.4f}")
        if r.signature:
            out.append(f"signature: {r.signature}")
        out += ["```", *split_lines(r.body)[:5], "```"]
    return "\n".join(out)
