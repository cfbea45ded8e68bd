"""Source text to chunks.

Python files are cut by the standard library's syntax tree; brace languages and Ruby by a scanner over masked text (no
literals, no comments), which finds the headers of the constructs below and the end of their blocks. It follows the
languages' block structure, not their full grammar: constructs built by macros or preprocessor branches may be missed.
Where nothing is found, and for text the scanner does not know, blocks of fixed length come out.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.lexers import masked
from sondage.functions.lines import lines_of, split_lines
from sondage.functions.paths import CONFIG_LANGUAGES, file_name, is_binary, language
from sondage.schemas import CHUNKS

# Least lines of a chunk, lines of a fallback block, longest config file that is one chunk.
LEAST_LINES, BLOCK_LINES, CONFIG_LINES = 2, 50, 100

_LEXER = {"rust": "rs", "javascript": "js", "typescript": "ts", "tsx": "ts", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "ruby": "rb"}
_JS = [
    (r"^[ \t]*(?P<all>export\b[^\n]*)", "block", True),
    (r"(?:^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?)(?P<all>(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]+)[^{;]*)\{", "function", False),
    (r"(?:^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?)(?P<all>(?:abstract[ \t]+)?class[ \t]+(?P<name>[\w$]+)[^{;]*)\{", "class", True),
    (r"(?P<all>(?:async[ \t]+)?(?:\([^()\n]*\)|[\w$]+)(?:[ \t]*:[ \t]*[^={\n]+)?[ \t]*=>[ \t]*)\{", "function", False),
    (r"^[ \t]*(?P<all>(?:(?:static|async|get|set|public|private|protected|override|readonly)[ \t]+|\*)*(?P<name>(?!(?:if|for|while|switch|catch|function|return|with)\b)[\w$#]+)[ \t]*(?:<[^>\n]*>)?\([^{};]*\)(?:[ \t]*:[ \t]*[^{;]+)?[ \t]*)\{", "method-in-class", False),
]
# The constructs that become chunks, their kind, and whether their inside is looked at too.
_RULES: dict[str, list[tuple[str, str, bool]]] = {
    "rust": [
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern)[ \t]+)*fn[ \t]+(?P<name>\w+)[^{;]*)[{;]", "function", False),
        (r"^[ \t]*(?P<all>(?:unsafe[ \t]+)?impl\b[^{;]*)\{", "module", True),
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<name>\w+)[^{;]*)[{;]", "struct", False),
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<name>\w+)[^{;]*)\{", "enum", False),
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+(?P<name>\w+)[^{;]*)\{", "interface", False),
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(?P<name>\w+)[^{;]*)[{;]", "module", True),
        (r"^[ \t]*(?P<all>(?:pub(?:\([^)]*\))?[ \t]+)?(?:const|static(?:[ \t]+mut)?|type)[ \t]+(?P<name>\w+)[^;{]*)[;{]", "block", False),
        (r"^[ \t]*(?P<all>macro_rules![ \t]*(?P<name>\w+)[^{(;]*)[{(]", "block", False),
    ],
    "javascript": _JS,
    "tsx": _JS,
    "typescript": [
        *_JS,
        (r"(?:^[ \t]*(?:export[ \t]+)?)(?P<all>(?:declare[ \t]+)?interface[ \t]+(?P<name>[\w$]+)[^{;]*)\{", "interface", True),
        (r"(?:^[ \t]*(?:export[ \t]+)?)(?P<all>(?:declare[ \t]+)?type[ \t]+(?P<name>[\w$]+)[^={;]*=[^;{]*)[;{]", "block", False),
    ],
    "go": [
        (r"^(?P<all>func[ \t]+(?P<name>\w+)[ \t]*[(\[][^\n]*?)\{[ \t]*$", "function", False),
        (r"^(?P<all>func[ \t]+\([^)]*\)[ \t]*(?P<name>\w+)[ \t]*\([^\n]*?)\{[ \t]*$", "method", False),
        (r"^(?P<all>type[ \t]+\w+[^\n{]*)\{", "block", False),
        (r"^(?P<all>type[ \t]*)\(", "block", False),
    ],
    "java": [
        (r"^[ \t]*(?P<all>(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*class[ \t]+(?P<name>\w+)[^{;]*)\{", "class", True),
        (r"^[ \t]*(?P<all>(?:(?:public|private|protected|static|abstract)[ \t]+)*interface[ \t]+(?P<name>\w+)[^{;]*)\{", "interface", True),
        (r"^[ \t]*(?P<all>(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+(?P<name>\w+)[^{;]*)\{", "enum", False),
        (r"^[ \t]*(?P<all>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>]*>[ \t]*)?(?!new\b|return\b|else\b|throw\b)(?:[\w.<>\[\],?]+[ \t]+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b)\w+)[ \t]*\([^;{}]*\)[^;{}]*)\{", "method", False),
    ],
    "c": [
        (r"^(?P<all>(?!else\b|return\b|typedef\b)[A-Za-z_][\w \t*]*?[ \t*](?P<name>\w+[ \t]*\([^;{}]*\))[^;{}()]*)\{", "function", False),
        (r"^[ \t]*(?:typedef[ \t]+)?(?P<all>struct(?:[ \t]+(?P<name>\w+))?[ \t\n]*)\{", "struct", False),
        (r"^[ \t]*(?:typedef[ \t]+)?(?P<all>enum(?:[ \t]+(?P<name>\w+))?[ \t\n]*)\{", "enum", False),
    ],
    "cpp": [
        (r"^[ \t]*(?P<all>namespace(?:[ \t]+(?P<name>[\w:]+))?[ \t\n]*)\{", "module", True),
        (r"^[ \t]*(?P<all>class[ \t]+(?P<name>\w+)[^{;()]*)\{", "class", True),
        (r"^[ \t]*(?:typedef[ \t]+)?(?P<all>struct(?:[ \t]+(?P<name>\w+))?[^{;()]*)\{", "struct", False),
        (r"^[ \t]*(?P<all>enum(?:[ \t]+(?:class|struct))?(?:[ \t]+(?P<name>\w+))?[^{;()]*)\{", "enum", False),
        (r"^[ \t]*(?P<all>(?!else\b|return\b|typedef\b|if\b|for\b|while\b|switch\b|catch\b|new\b|throw\b)(?:[A-Za-z_][\w:<>,&* \t]*?[ \t*&])?(?P<name>~?[\w:~]+[ \t]*\([^;{}]*\))[^;{}()]*)\{", "function", False),
    ],
}
_RX = {k: [(re.compile(p, re.M), kind, deep) for p, kind, deep in rules] for k, rules in _RULES.items()}
_RUBY = re.compile(r"^(?P<pad>[ \t]*)(?P<word>def|class|module)[ \t]+(?P<name>(?:self\.)?[\w:?!=]+)", re.M)
_PAIRS = {"{": "}", "(": ")"}


def _closers(text: str) -> dict[int, int]:
    """Where every opening brace and parenthesis is closed."""
    ends, stack = {}, []
    for m in re.finditer(r"[{}()]", text):
        if m[0] in _PAIRS:
            stack.append(m)
        else:
            while stack:
                top = stack.pop()
                if _PAIRS[top[0]] == m[0]:
                    ends[top.start()] = m.end()
                    break
    return ends


def _doc(text: str, start: int, comments: list[tuple[int, int]]) -> str | None:
    """The comments right before ``start``, blank lines between them or not, without their line marks."""
    found = []
    for a, z in reversed(comments[: bisect_right(comments, (start, start))]):
        if z > start or text[z:start].strip():
            break
        found.append(text[a:z])
        start = a
    cleaned = "\n".join(re.sub(r"^(?:///|//!|//|#)", "", line.strip()).strip() for block in reversed(found) for line in split_lines(block))
    return cleaned if cleaned.strip() else None


def signature_of(body: str) -> str | None:
    """The text before the first brace; else, of a def or class, through the first colon; else the first line."""
    head, brace, _ = body.partition("{")
    if brace and head.strip():
        return head.strip()
    head, colon, _ = body.partition(":")
    if colon and ("def " in head or "class " in head):
        return (head + ":").strip()
    return next((line.strip() or None for line in split_lines(body)), None)


def _found_python(text: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, name) of functions and classes, decorated ones as a block and by themselves."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    starts = [0, *(m.end() for m in re.finditer("\r\n|\r|\n", text)), len(text)]

    def at(line: int, column: int) -> int:
        row = text[starts[line - 1] : starts[line]]
        return starts[line - 1] + len(row.encode()[:column].decode(errors="ignore"))

    found = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                start, end = at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)
                if child.decorator_list:
                    first = child.decorator_list[0]
                    found.append((text.rfind("@", 0, at(first.lineno, first.col_offset) + 1), end, "block", None))
                found.append((start, end, "class" if isinstance(child, ast.ClassDef) else "function", child.name))
                if isinstance(child, ast.ClassDef):
                    visit(child)
            else:
                visit(child)

    visit(tree)
    return found


def _found_ruby(text: str, code: str) -> list[tuple[int, int, str, str | None]]:
    """Methods, modules and classes; the ``end`` in the column of the header closes it."""
    found, inside = [], 0
    for m in _RUBY.finditer(code):
        if m.start("word") < inside:
            continue
        close = re.compile(rf"^{m['pad']}end\b", re.M).search(code, m.end())
        if close:
            kind = {"def": "method", "class": "block", "module": "module"}[m["word"]]
            found.append((m.start("word"), close.end(), kind, m["name"].removeprefix("self.")))
            if m["word"] != "module":
                inside = close.end()
    return found


def _found_braces(code: str, rules: list[tuple[re.Pattern, str, bool]]) -> list[tuple[int, int, str, str | None]]:
    ends = _closers(code)
    heads = []
    for rx, kind, deep in rules:
        for m in rx.finditer(code):
            start, last = m.start("all"), m.end() - 1
            if kind == "block" and code.startswith("export", start):
                brace = re.compile(r"[{;]").search(code, start)
                last = brace.start() if brace else len(code) - 1
            end = ends.get(last) if code[last] in _PAIRS else last + 1
            if end is not None:
                heads.append((start, -end, kind, m.groupdict().get("name"), deep))
    heads.sort()
    found, closed, classes = [], 0, []
    for start, end, kind, name, deep in heads:
        end = -end
        if start < closed or (found and found[-1][:2] == (start, end)):
            continue
        if kind == "method-in-class":
            if not any(a < start < z for a, z in classes):
                continue
            kind = "method"
        found.append((start, end, kind, name and name.strip()))
        if kind == "class":
            classes.append((start, end))
        if not deep:
            closed = end
    return found


def cut(text: str, lang: str) -> list[dict]:
    """The chunks of a text by its constructs: dictionaries of the chunk's columns but id and file_path."""
    code, comments = ("", [])
    if lang == "python":
        _, comments = masked(text, "py")
        found = _found_python(text)
    elif lang == "ruby":
        code, comments = masked(text, "rb")
        found = _found_ruby(text, code)
    elif lang in _RX:
        code, comments = masked(text, _LEXER[lang])
        found = _found_braces(code, _RX[lang])
    else:
        found = []
    line_ends = [m.start() for m in re.finditer("\n", text)]
    chunks = []
    for start, end, kind, name in found:
        body = text[start:end]
        first, last = bisect_right(line_ends, start - 1), bisect_right(line_ends, end - 1) + 1
        if body and last - first >= LEAST_LINES:
            at = len(text[:start].encode())
            chunks.append({"kind": kind, "name": name, "signature": signature_of(body), "doc_comment": _doc(text, start, comments), "body": body, "byte_start": at, "byte_end": at + len(body.encode()), "line_start": first, "line_end": last})
    return chunks


def _blocks(text: str, name: str) -> list[dict]:
    lines = split_lines(text)
    out, at = [], 0
    for first in range(0, len(lines), BLOCK_LINES):
        last = min(first + BLOCK_LINES, len(lines))
        body = "\n".join(lines[first:last])
        size = len(body.encode())
        out.append({"kind": "block", "name": f"{name}:L{first + 1}-L{last}", "signature": None, "doc_comment": None, "body": body, "byte_start": at, "byte_end": at + size, "line_start": first, "line_end": last})
        at += size + 1
    return out


def chunk_text(path: str, text: str, lang: str) -> list[dict]:
    """The chunks of one file. A config file is one chunk, or none if it is long."""
    name = path.rpartition("/")[2]
    if lang in CONFIG_LANGUAGES:
        lines = split_lines(text)
        if not lines or len(lines) > CONFIG_LINES:
            return []
        return [{"kind": "block", "name": name, "signature": None, "doc_comment": None, "body": text, "byte_start": 0, "byte_end": len(text.encode()), "line_start": 0, "line_end": len(lines)}]
    return cut(text, lang) or _blocks(text, name)


def chunk_id(path: Column, start: Column, end: Column, kind: Column) -> Column:
    """An id that depends on the place alone, so that runs agree and kept chunks are never overwritten."""
    return F.xxhash64(path, start, end, kind)


def chunk_files(files: DataFrame, path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """The chunks of files (path, text); files of unknown languages and null texts have none. One narrow pass."""
    out = "file_path string, language string, kind string, name string, signature string, doc_comment string, body string, byte_start bigint, byte_end bigint, line_start int, line_end int"
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"file_path": p, "language": lang} | c for p, t, lang in b.itertuples(index=False, name=None) for c in chunk_text(p, t, lang)]
            yield pd.DataFrame(rows, columns=names)

    source = files.select(F.col(path_column).alias("p"), F.col(text_column).alias("t"), language(F.col(path_column)).alias("l")).where("p is not null and t is not null and l is not null")
    chunks = source.mapInPandas(run, out)
    return chunks.select(chunk_id(F.col("file_path"), F.col("byte_start"), F.col("byte_end"), F.col("kind")).alias("id"), *names).select(CHUNKS.fieldNames())


def readable(files: DataFrame) -> DataFrame:
    """(file_path, text, mtime, size) of raw files (path, content, ...) whose content is text in valid UTF-8."""
    text = F.col("content").cast("string")
    return files.where(~is_binary(F.col("content")) & F.is_valid_utf8(text)).select(F.col("path").alias("file_path"), text.alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def fallback_chunks(documents: DataFrame, path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """Blocks of BLOCK_LINES lines as expressions alone: (file_path, name, body, byte_start, byte_end, line_start, line_end)."""
    lines = lines_of(F.col(text_column))
    blocks = F.transform(
        F.sequence(F.lit(0), F.size("lines") - 1, F.lit(BLOCK_LINES)),
        lambda first: F.struct(first.alias("line_start"), F.array_join(F.slice("lines", first + 1, F.lit(BLOCK_LINES)), "\n").alias("body"), F.least(first + BLOCK_LINES, F.size("lines")).alias("line_end")),
    )
    # A block starts behind the blocks before it and a line end each: one running sum over the blocks of a file.
    zero = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("blocks", zero, lambda s, b: F.struct((s["next"] + F.octet_length(b["body"]) + 1).alias("next"), F.concat(s["starts"], F.array(s["next"])).alias("starts")))["starts"]
    rows = documents.select(F.col(path_column).alias("file_path"), lines.alias("lines")).where(F.size("lines") > 0).select("file_path", blocks.alias("blocks"))
    rows = rows.select("file_path", F.explode(F.arrays_zip("blocks", starts.alias("starts"))).alias("b")).select("file_path", "b.blocks.*", F.col("b.starts").alias("byte_start"))
    name = F.concat(file_name(F.col("file_path")), F.lit(":L"), (F.col("line_start") + 1).cast("string"), F.lit("-L"), F.col("line_end").cast("string"))
    return rows.select("file_path", name.alias("name"), "body", "byte_start", (F.col("byte_start") + F.octet_length("body")).alias("byte_end"), "line_start", "line_end")
