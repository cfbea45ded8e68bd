"""Signature patterns: parsed on the driver, scored per chunk."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.errors import InvalidPattern
from sondage.functions.lines import lines_of
from sondage.operators.summary import trimmed

# Words of the pattern language, weights of the criteria, groups of type names.
QUALIFIERS = ("async", "pub", "static", "export", "private", "protected", "public", "abstract", "virtual", "override", "const", "mut", "unsafe")
KIND_WORDS = {"fn": "function", "func": "function", "function": "function", "def": "function", "method": "function", "class": "class", "struct": "struct", "enum": "enum", "interface": "interface", "trait": "interface", "protocol": "interface", "*": "any"}
CHUNK_KINDS = {"function": ("function", "method"), "class": ("class",), "struct": ("struct",), "enum": ("enum",), "interface": ("interface",)}
WEIGHTS = {"kind": 0.3, "qualifiers": 0.1, "name": 0.3, "params": 0.15, "returns": 0.15}
TYPE_GROUPS = [
    (("string", "str"), ("string", "str", "&str", "std::string::string", "text")),
    (("number", "num", "int", "integer"), ("i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "int", "int8", "int16", "int32", "int64", "uint", "float", "float32", "float64", "number", "double")),
    (("bool", "boolean"), ("bool", "boolean")),
    (("void", "none", "unit", "()"), ("void", "none", "()", "unit", "null")),
]
TOP_K = 20
_TOKEN = re.compile(r"->|[(),]|(?:(?!->)[^(), \t])+")
_MARKS = ("(", ")", ",", "->")


@dataclass
class Pattern:
    """What a pattern asks for; None where it does not say."""

    kind: str = "function"
    qualifiers: list[str] = field(default_factory=list)
    name: str | None = None
    params: list[str] | None = None
    returns: str | None = None


def parse(text: str) -> Pattern:
    """``[qualifiers] kind [name] [(types)] [-> type]``; a first word that is no kind starts a function pattern."""
    left = _TOKEN.findall(text.strip())
    if not left:
        raise InvalidPattern("an empty pattern")
    left.reverse()
    found = Pattern()
    while left and left[-1] in QUALIFIERS:
        found.qualifiers.append(left.pop())
    if not left:
        raise InvalidPattern("qualifiers without a kind: " + text)
    if kind := KIND_WORDS.get(left[-1].lower()):
        found.kind = kind
        left.pop()
    if left and left[-1] not in _MARKS:
        found.name = left.pop()
    if left and left[-1] == "(" and found.kind in ("function", "any"):
        left.pop()
        found.params = []
        while left and (token := left.pop()) != ")":
            if token != ",":
                found.params.append(token)
    if len(left) > 1 and left[-1] == "->":
        found.returns = " ".join(reversed(left[:-1]))
    return found


def glob(pattern: str) -> str:
    """A case-folded pattern with * for any text as an anchored regular expression."""
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.lower().split("*")) + "$"


def wildcard_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches, whatever the case; * stands for any text."""
    if "*" not in pattern:
        return F.lower(text) == pattern.lower()
    return F.lower(text).rlike("(?s)^" + ".*".join(re.sub(r"([^\w])", r"\\\1", p) for p in pattern.lower().split("*")) + "$")


def type_matches(pattern: str, actual: str) -> bool:
    """Whether a type fits a pattern's: equal, by glob, of one group, or one within the other."""
    pattern, actual = pattern.strip().lower(), actual.strip().lower()
    if pattern in ("*", actual):
        return True
    if "*" in pattern:
        return re.match(glob(pattern), actual) is not None
    for words, types in TYPE_GROUPS:
        if pattern in words:
            return actual in types
    return pattern in actual or actual in pattern


def type_matches_column(pattern: str, actual: Column) -> Column:
    """The same as an expression."""
    pattern, actual = pattern.strip().lower(), F.lower(trimmed(actual))
    if pattern == "*":
        return F.lit(True)
    if "*" in pattern:
        return wildcard_match(actual, pattern)
    for words, types in TYPE_GROUPS:
        if pattern in words:
            return (actual == pattern) | actual.isin(*types)
    return F.contains(actual, F.lit(pattern)) | F.contains(F.lit(pattern), actual)


def param_types(signature: str) -> list[str]:
    """The types between the first parenthesis and its match; none if it has no match."""
    start = signature.find("(")
    if start < 0:
        return []
    depth, end = 0, -1
    for m in re.finditer(r"[()]", signature[start:]):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            end = start + m.start()
            break
    if end < 0:
        return []
    parts, depth, at = [], 0, start + 1
    for i in range(start + 1, end):
        ch = signature[i]
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and depth == 0:
            parts.append(signature[at:i])
            at = i + 1
    parts.append(signature[at:end])
    types = []
    for part in map(str.strip, parts):
        if ":" in part:
            part = part.split(":", 1)[1].strip().lstrip("&")
            while part.startswith("mut "):
                part = part[4:]
            types.append(part.strip())
        elif part:
            types.append(part.split()[-1])
    return types


def params_score(wanted: list[str], types: list[str]) -> float:
    """The share of the wanted types found, in order, among the actual ones."""
    if wanted == ["*"] or not wanted and not types:
        return 1.0
    if not wanted or not types or sum(p != "*" for p in wanted) > len(types):
        return 0.0
    left, hits = iter(types), 0
    for want in wanted:
        if want == "*":
            hits += 1
            next(left, None)
        elif any(type_matches(want, t) for t in left):
            hits += 1
    return hits / len(wanted)


def return_type(signature: Column) -> Column:
    """What follows the first arrow, or a colon after the last closing parenthesis; null if nothing does."""
    arrow = F.instr(signature, "->")
    after_arrow = F.regexp_replace(trimmed(F.substr(signature, arrow + 2)), r"(?U)[{:\s]+$", "")
    tail = trimmed(F.substring_index(signature, ")", -1))
    after_colon = F.regexp_replace(trimmed(F.substr(tail, F.lit(2))), r"(?U)[{\s]+$", "")
    has_colon = F.contains(signature, F.lit(")")) & F.startswith(tail, F.lit(":"))
    return F.when((arrow > 0) & (after_arrow != ""), after_arrow).when(has_colon & (after_colon != ""), after_colon)


def kind_filter(pattern: Pattern) -> Column:
    """The kinds of chunk a pattern takes; reaches the scan."""
    return F.lit(True) if pattern.kind == "any" else F.col("kind").isin(*CHUNK_KINDS[pattern.kind])


def score(pattern: Pattern) -> Column:
    """Earned over possible weight of a chunk of the right kind; the criteria a pattern leaves open do not count."""
    earned, possible = F.lit(WEIGHTS["kind"]), WEIGHTS["kind"]
    text = F.coalesce("signature", "body")
    if pattern.qualifiers:
        possible += WEIGHTS["qualifiers"]
        first = F.coalesce(F.try_element_at(lines_of(F.col("body")), F.lit(1)), F.lit(""))
        where = F.lower(F.concat(F.coalesce("signature", F.lit("")), F.lit(" "), first))
        hits = sum((F.contains(where, F.lit(q)).cast("double") for q in pattern.qualifiers), F.lit(0.0))
        earned = earned + F.lit(WEIGHTS["qualifiers"]) * hits / F.lit(float(len(pattern.qualifiers)))
    if pattern.name is not None:
        possible += WEIGHTS["name"]
        part = F.contains(F.lower("name"), F.lit(pattern.name.lower().replace("*", "")))
        share = F.when(wildcard_match(F.col("name"), pattern.name), 1.0).when(part, 0.5).otherwise(0.0)
        earned = earned + F.lit(WEIGHTS["name"]) * share
    if pattern.params is not None:
        possible += WEIGHTS["params"]
        wanted = list(pattern.params)
        if wanted == ["*"]:
            share = F.lit(1.0)
        else:

            @F.pandas_udf("double")
            def share_of(signatures: pd.Series) -> pd.Series:
                known = {s: params_score(wanted, param_types(s)) for s in signatures.dropna().unique()}
                return signatures.map(known).fillna(0.0).astype(float)

            share = share_of(text)
        earned = earned + F.lit(WEIGHTS["params"]) * share
    if pattern.returns is not None:
        possible += WEIGHTS["returns"]
        actual = return_type(text)
        if pattern.returns == "*":
            share = F.lit(1.0)
        else:
            share = F.when(type_matches_column(pattern.returns, actual), 1.0).when(F.contains(F.lower(actual), F.lit(pattern.returns.lower())), 0.5).otherwise(0.0)
        earned = earned + F.lit(WEIGHTS["returns"]) * share
    return earned / F.lit(possible)


def search_pattern(chunks: DataFrame, pattern: str, top_k: int = TOP_K, least: float = 0.0) -> DataFrame:
    """(chunk_id, score): best chunks for a signature pattern, ties by id.

    The kinds reach the scan and no text is moved: repeated rows of a chunk meet as scores, of which the best counts.
    """
    wanted = parse(pattern)
    rows = chunks.where(kind_filter(wanted)).select(F.col("id").alias("chunk_id"), score(wanted).alias("score"))
    return rows.where(F.col("score") > least).groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top_k)
