r"""Functions paired with their documentation.

Source files are lexed once into tokens; the tokens are exploded into rows. Gaps-and-islands windows over a file's rows
join comment lines into comments and attribute lines into attribute blocks; a lag window hands the comment before an
attribute block on to the line after it. A cumulative-depth window delimits the functions: the depth of braces, of Python's
indents or of Ruby's blocks. Functions and comments meet by file and line. No row but the text's own lexing passes through
Python before the documentation is judged.

Cases: a comment parted from the function by a blank line is none of its documentation; a doc_comment counts only where
the file's text is not there to look in; nulls in any column, empty texts and empty tables give no pair; a repeated chunk
counts once; comments are judged in their visually consistent form; very long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondage.functions.lexers import LEXERS, Lexed, extension
from sondage.llm.visual_form import one_form
from sondage.storage import written

#: Languages whose comments are looked for.
CODE = frozenset(("py", "rs", "js", "ts", "go", "java", "c", "cpp", "rb"))
#: Documentation says something in at least so many words that are no words of the function's name.
LEAST_WORDS = 6

_ATTRIBUTE = {
    "rs": re.compile(r"^[ \t]*#!?\[", re.M),
    "c": re.compile(r"^[ \t]*(?:__attribute__|\[\[)", re.M),
    "cpp": re.compile(r"^[ \t]*(?:__attribute__|\[\[|template[ \t]*<)", re.M),
} | {k: re.compile(r"^[ \t]*@(?!interface\b)\w", re.M) for k in ("py", "java", "js", "ts")}
_CLOSER = re.compile(r"[()\[\]]|\n")


def tokens_of(text: str, language: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, text) of comments on lines of their own (c) and of attributes (a), in order."""
    ends = [m.start() for m in re.finditer("\n", text)]
    found, spans = [], []
    for m in LEXERS[language].finditer(text):
        a, b = m.span()
        if m.lastgroup != "c":
            if m.lastgroup in ("s", "t", "q", "h"):
                spans.append((a, b))
            continue
        spans.append((a, b))
        before = text[text.rfind("\n", 0, a) + 1 : a]
        stop = text.find("\n", b)
        if not before.strip() and not text[b : stop if stop >= 0 else len(text)].strip():
            found.append((bisect_right(ends, a - 1), bisect_right(ends, b - 1), "c", m[0]))
    if rx := _ATTRIBUTE.get(language):
        starts = [s for s, _ in spans]
        for m in rx.finditer(text):
            k = bisect_right(starts, m.end() - 1) - 1
            if k >= 0 and spans[k][1] > m.end() - 1:
                continue
            depth, stop = 0, len(text)
            for c in _CLOSER.finditer(text, m.start()):
                depth += (c[0] in "([") - (c[0] in ")]")
                if c[0] == "\n" and depth <= 0:
                    stop = c.start()
                    break
            line = text[m.start() : stop].rstrip()
            if language == "rs" and not line.endswith("]") or language == "java" and line.endswith("{"):
                continue
            found.append((bisect_right(ends, m.start()), bisect_right(ends, max(stop - 1, m.start())), "a", ""))
        found.sort()
    return found


_TOKEN = "array<struct<first:int,last:int,kind:string,text:string>>"


_STEPS = "array<struct<line:int,up:int,down:int,name:string>>"
_TOKEN_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))
_STEP_ARROW = pa.list_(pa.struct([("line", pa.int32()), ("up", pa.int32()), ("down", pa.int32()), ("name", pa.string())]))


def parsed(documents: DataFrame, path_column: str = "file_path", text_column: str = "text", languages: frozenset[str] = CODE) -> DataFrame:
    """(file, file_path, tokens, steps) of every text with a path: one lexing pass; ``file`` tells repeated rows apart.

    ``tokens`` are comments and attributes, ``steps`` the lines where the depth changes or a function starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, steps = [], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                language = extension(path)
                known = language in languages
                tokens.append([{"first": f, "last": e, "kind": k, "text": t} for f, e, k, t in tokens_of(text, language)] if known else [])
                steps.append(_depth_lines(text, language) if known else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, _TOKEN_ARROW), pa.array(steps, _STEP_ARROW)], names=["file_path", "tokens", "steps"])

    source = documents.select(documents[path_column].alias("file_path"), documents[text_column].alias("text")).where("file_path is not null and text is not null")
    out = source.mapInArrow(run, f"file_path string, tokens {_TOKEN}, steps {_STEPS}")
    return out.select(F.monotonically_increasing_id().alias("file"), "file_path", "tokens", "steps")


def attached(files: DataFrame) -> DataFrame:
    """(file_path, line, comment) of parsed files: the comment that ends on the line above ``line``, or above the attributes before it.

    Islands are stretches of tokens without a line between; runs are the comments, and the attributes, of an island.
    """
    tokens = files.select("file", "file_path", F.inline("tokens"))
    file = Window.partitionBy("file").orderBy("first", "last", "kind")
    apart = F.coalesce(F.col("first") > F.lag("last").over(file) + 1, F.lit(True))
    other = F.coalesce(F.col("kind") != F.lag("kind").over(file), F.lit(True))
    marked = tokens.withColumn("apart", apart.cast("int")).withColumn("other", (apart | other).cast("int"))
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("island", F.sum("apart").over(upto)).withColumn("run", F.sum("other").over(upto))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("first", "text"))), lambda x: x["text"])
    runs = placed.groupBy("file", "file_path", "island", "run", "kind").agg((F.max("last") + 1).alias("line"), F.array_join(lines, "\n").alias("text"))
    order = Window.partitionBy("file").orderBy("run")
    above = F.when(F.lag("island").over(order) == F.col("island"), F.lag("text").over(order))
    comment = F.when(F.col("kind") == "c", F.col("text")).otherwise(above)
    return runs.select("file_path", "line", comment.alias("comment")).where("comment is not null")


_DEF = re.compile(r"\s*(?:async\s+)?def\b")
_STEP = re.compile(r"(?P<o>[(\[{])|(?P<e>[)\]}])|(?P<n>:)|" + LEXERS["py"].pattern, re.M)
_GAP = re.compile(r"(?:\s|#[^\n]*\n)*")
_STRING = re.compile(r"[rRuU]?(?:\"\"\"((?:[^\\]|\\[\s\S])*?)\"\"\"|\x27\x27\x27((?:[^\\]|\\[\s\S])*?)\x27\x27\x27|\"((?:[^\"\\\n]|\\[\s\S])*)\"|\x27((?:[^\x27\\\n]|\\[\s\S])*)\x27)")


def docstring(body: str | None) -> str | None:
    """The string that opens the body of a Python function; None if there is none."""
    if not body or not (m := _DEF.match(body)):
        return None
    depth = 0
    for step in _STEP.finditer(body, m.end()):
        if step.lastgroup == "o":
            depth += 1
        elif step.lastgroup == "e":
            depth -= 1
        elif step.lastgroup == "n" and depth == 0:
            s = _STRING.match(body, _GAP.match(body, step.end()).end())
            return next((g for g in s.groups() if g is not None), None) if s else None
    return None


_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|///+|//+!?|#+!?|--+|;+|\"\"\"|\x27\x27\x27)?[ \t]?|[ \t]*\*+/[ \t]*$")
_TAG = re.compile(r"^(?:[@\\](?!brief\b|summary\b|description\b|desc\b|details?\b|remarks?\b|note\b)\w+|:(?:param|type|returns?|rtype|raises?|arg|keyword|ivar|cvar|var|meta)\b|\{@\w+|(?:args?|arguments|parameters?|params|returns?|raises|throws|yields|examples?|see also|attributes|inputs?|outputs?)\s*:\s*$|[-*]?\s*`?\w+`?\s*\([^()]*\)\s*:|[-*]\s*`?\w+`?\s*(?::|--?\s))", re.I)
_PROSE_TAG = re.compile(r"^[@\\](?:brief|summary|description|desc|details?|remarks?|note)\b[:\s]*", re.I)
_NOTICE = re.compile(
    r"copyright\b|\(c\)\s*\d{4}|©|spdx-|all rights reserved|licen[sc]ed under|(?:under|to) the terms of (?:the|this|that)|see the licen[sc]e|licen[sc]e (?:file|in the root)|without (?:any )?warrant|^(?:@?authors?|maintainers?|contributors?|written by|created by|maintained by|modified by|created on|last (?:changed|modified|edited)|version|since|date|file ?name)\b\s*[:\-]|^(?:@author|written by|created by|maintained by|modified by|last (?:changed|modified) (?:by|on))\b"
    r"|part of [\w.-]+\. see the|autor\s*:|auteur\s*:|автор\s*:|作者",
    re.I,
)
_ORDER = re.compile(
    r"^(?:pylint|eslint(?:-[\w-]+)?|noqa|type:\s*ignore|rubocop|clang-(?:format|tidy)|nolint\w*|prettier-ignore\w*|tslint|jshint|jslint|istanbul|c8 ignore|v8 ignore|go:\w+|\+build|pragma\b\W|fmt:|yapf|isort|mypy|pyright|flake8|shellcheck|nosonar|nosec|checkstyle|@ts-\w+|@formatter|@phpstan\S*|language=|-\*-|vim?:|ex:|cspell|codespell|coverage:|sonar\S*:|rustfmt|clippy|swiftlint|detekt|ktlint|biome-ignore|deno-lint\S*|webpack\w*:|sourcemappingurl|#?(?:end)?region\s*(?::|$)|mark:|lint:|line:|cppcheck|lcov_\w+|gcov\w*|uncrustify|stylelint\S*|frozen_string_literal|encoding:|coding[:=]|!/)",
    re.I,
)
_PLACEHOLDER = re.compile(r"^(?:(?:todo|fixme|xxx|tbd|tba|wip)\b|hack:|placeholder\b|stub\W*$|auto[- ]?generated (?:method |function )?stub|(?:insert|add|write|put) (?:a |an |the |some )?(?:description|documentation|comment|docs?|docstring|something|text)\b|(?:description|documentation|docs?|text|comment) (?:goes |comes )?here|(?:document|describe) (?:me|this|it)\b|missing docs?|no docs?\b|(?:not|still) (?:yet )?(?:documented|to be documented))", re.I)
_RULER = re.compile(r"^(?:[^\w\s]{3,}.*[^\w\s]{3,}|[\W_]*)$")
_CODE_SIGN = re.compile(r"[;{}]\s*$|^\s*[{})\]]|\w\s*(?:[-+*/|&%]?=|:=|==|!=|->|=>|<-|\+\+|--)(?!\w*>)|\w\(|\w\[\w*\]|\w\.\w+\(|\w_\w|[a-z][A-Z]|::|&&|\|\||^\s*(?:#\[|@\w)")
_CODE_WORD = re.compile(r"^\s*(?:end|else|begin|ensure|rescue(?:\s+\w+)?|try|finally|pass|break|continue|return(?:\s+[\w.]+)?|(?:if|while|elif|unless|for|switch|case|default|except|catch|with|def|class|match|when)\b[^.]*[:<>=]\s*\w*|\}?\s*else\s*\{?)\s*[:;]?\s*$")
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_PLAIN = re.compile(r"(?<![\w.])[^\W\d_]+(?:[,]?[ \t]+[^\W\d_]+)+(?![\w(.=\[])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿฀-๿가-힯]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")


def _is_code(line: str) -> bool:
    bare = _QUOTED.sub('""', line)
    if _CODE_WORD.match(bare):
        return True
    if not _CODE_SIGN.search(bare):
        return False
    return max((len(run.split()) for run in _PLAIN.findall(bare)), default=0) < 4


def prose_words(comment: str, name: str | None) -> int:
    """The words of prose in a comment that are no words of ``name``; in scripts without spaces two signs are a word."""
    known = {w.casefold() for w in _CAMEL.findall(name or "")} | {(name or "").casefold()}
    count, in_tag = 0, False
    for raw in one_form(comment).splitlines():
        line = raw
        for _ in range(2):
            line = _MARK.sub("", line)
        indent = len(line) - len(line.lstrip())
        line = _PROSE_TAG.sub("", line.strip())
        if not line or _RULER.match(line):
            in_tag = False
            continue
        if _TAG.match(line):
            in_tag = True
            continue
        if in_tag and indent >= 2:
            continue
        in_tag = False
        if _NOTICE.search(line) or _ORDER.match(line) or _PLACEHOLDER.match(line) or _is_code(line):
            continue
        for run in _UNSPACED.findall(line):
            count += len(run) // 2
        count += sum(1 for w in _WORD.findall(_UNSPACED.sub(" ", line)) if w.casefold() not in known)
    return count


def meaningful(comment: str | None, name: str | None) -> bool:
    """Whether a comment says something in prose."""
    return bool(comment) and prose_words(comment, name) >= LEAST_WORDS


def _with_docstring(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and docstring; bodies of Python functions alone go through Python."""
    source = chunks.select(*keep, F.when(F.lower("language") == "python", F.col("body")).alias("_body"))
    schema = source.drop("_body").schema.add("docstring", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([docstring(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*keep, "docstring"])

    return source.mapInArrow(run, schema)


def _judged(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Rows of which one of ``texts`` is meaningful for ``name``, with it as ``documentation``; others fall away."""
    schema = rows.drop(*texts).schema.add("documentation", "string")
    names = [f for f in rows.columns if f not in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = pa.RecordBatch.from_arrays(b.columns, names=rows_columns)
            at, docs = [], []
            for i, (name, *found) in enumerate(zip(b.column(name_at).to_pylist(), *(b.column(t).to_pylist() for t in texts_at))):
                good = [t for t in found if meaningful(t, name)]
                if good:
                    at.append(i)
                    docs.append("\n".join(good))
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(n) for n in kept_at), pa.array(docs, pa.string())], names=[*names, "documentation"])

    rows_columns = rows.columns
    name_at, texts_at, kept_at = rows_columns.index("name"), [rows_columns.index(t) for t in texts], [rows_columns.index(n) for n in names]
    return rows.mapInArrow(run, schema)


def documented_functions(chunks: DataFrame, documents: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns of chunks and ``documentation``, for functions and methods with a meaningful one.

    Functions are delimited and comments attached in the files; chunks give the id of a function that starts on a line, and
    the docstring of its body. A chunk of a file that is not there has its stored comment. Only names, places and comments
    move; bodies stay where they are unless ``keep`` asks for them.
    """
    files = written(parsed(documents), "parsed")
    comments = attached(files).withColumnRenamed("line", "line_start")
    found = delimited(files).select("file_path", "line_start").distinct().join(comments, ["file_path", "line_start"], "left").withColumn("delimited", F.lit(True))
    need = list(dict.fromkeys([*keep, "file_path", "name", "line_start", "doc_comment"]))
    functions = chunks.where(F.lower("kind").isin("function", "method") & F.col("id").isNotNull())
    functions = _with_docstring(functions, need)
    there = files.select("file_path", F.lit(True).alias("there")).distinct()
    joined = functions.join(found, ["file_path", "line_start"], "left").join(there, "file_path", "left")
    stored = F.when(F.col("there").isNull(), F.col("doc_comment"))
    rows = joined.where(F.coalesce(F.col("delimited"), F.col("there").isNull()) & F.coalesce("comment", "docstring", stored).isNotNull())
    out = list(dict.fromkeys([*keep, "name"]))
    judged = _judged(rows.select(*out, "comment", "docstring", stored.alias("stored")), ["comment", "docstring", "stored"])
    return judged.select(*keep, "documentation").dropDuplicates([keep[0]])


_FUNCTION = {
    "rs": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern)[ \t]+(?:\x01[ \t]+)?)*fn[ \t]+(\w+)",
    "go": r"^func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)[ \t]*[(\[]",
    "js": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*([\w$]+)|^[ \t]+(?:static[ \t]+|async[ \t]+|get[ \t]+|set[ \t]+|\*)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([\w$#]+)[ \t]*\([^()]*\)[ \t]*(?::[^={]*)?\{",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>]*>[ \t]*)?(?!new\b|return\b|else\b|throw\b)[\w.<>\[\], ?]+[ \t]+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)[ \t]*\([^;{}]*\)[^;{}]*\{",
    "c": r"^(?!#)(?!else\b|return\b|typedef\b|struct[ \t]+\w+[ \t]*\{)[\w:*&<>, \t]*?\b(?!if\b|for\b|while\b|switch\b)([\w~:]+)[ \t]*\([^;{}]*\)[^;{}()]*\{",
}
_FUNCTION["ts"], _FUNCTION["cpp"] = _FUNCTION["js"], _FUNCTION["c"]
_FUNCTION_RX = {k: re.compile(v, re.M) for k, v in _FUNCTION.items()}


def _brace_lines(text: str, language: str) -> list[dict]:
    """Lines where the brace depth changes or a function starts: (line, change, lowest on the way, name)."""
    code = Lexed(text.replace("\r\n", "\n"), language).code
    starts = {}
    for m in _FUNCTION_RX[language].finditer(code):
        starts.setdefault(code.count("\n", 0, m.start(m.lastindex)), m[m.lastindex])
    rows = []
    for n, line in enumerate(code.split("\n")):
        up, down = line.count("{"), line.count("}")
        if up or down or n in starts:
            rows.append({"line": n, "up": up, "down": down, "name": starts.get(n)})
    return rows


_PY_DEF = re.compile(r"(?:async[\s\x03]+)?def[\s\x03]+(\w+)")
_PY_BLOCK = re.compile(r"[ \t\f]*(?:(?:async[ \t]+)?def|class|@)(?:\b|(?<=@)\w)")
_PY_SIGN = re.compile(r"[()\[\]{}\n\x03]")


def _step(line: int, up: int, name: str | None = None) -> dict:
    return {"line": line, "up": up, "down": 1 - up, "name": name}


def _indent_lines(text: str) -> list[dict]:
    """Python's steps of depth by the indent of logical lines: one up where a block opens, one down per block that ends.

    Lines inside brackets and strings open and end nothing. A function whose body stands on the line of its ``def`` goes
    up and down there.
    """

    def swap(m: re.Match) -> str:
        return "" if m.lastgroup == "c" else "\x01" + "\x03" * m[0].count("\n")

    code = LEXERS["py"].sub(swap, text.replace("\r\n", "\n")).replace("\\\n", " \x03") + "\n"
    logical: list[tuple[int, int, int, str]] = []
    at = first = line = depth = 0
    for m in _PY_SIGN.finditer(code):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth = max(depth - 1, 0)
        else:
            line += 1
            if m[0] == "\x03" or depth and not _PY_BLOCK.match(code, m.end()):
                continue
            depth = 0
            part = code[at : m.start()]
            if bare := part.lstrip(" \t\f\x03"):
                lead = part[: len(part) - len(bare)]
                logical.append((first + lead.count("\x03"), line - 1, len(lead.rpartition("\f")[2].expandtabs(8)), bare))
            at, first = m.end(), line
    rows, indents = [], [0]
    for n, (first, last, indent, bare) in enumerate(logical):
        after = logical[n + 1][2] if n + 1 < len(logical) else 0
        name = m[1] if (m := _PY_DEF.match(bare)) else None
        if after > indents[-1]:
            indents.append(after)
            rows.append(_step(first, 1, name))
            continue
        if name is not None:
            rows += [_step(first, 1, name), _step(last, 0)]
        while after < indents[-1]:
            indents.pop()
            rows.append(_step(last, 0))
    return rows


_RB_STEP = re.compile(
    r"(?P<n>\n)|(?P<o>[(\[{])|(?P<e>[)\]}])|(?P<s>;)"
    r"|(?<![\w.:@$])(?:def[ \t]+(?P<d>(?:\w+\.)?(?:[^\W\d]\w*(?:[?!]|=(?=[ \t]*\())?|\[\]=?|[-+!~]@?|\*\*|<=>|===?|=~|![=~]|<<|>>|<=|>=|[*/%<>&|^`]))"
    r"(?P<l>[ \t]*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[ \t]*=(?![=~>])|[ \t]+=(?![=~>]))?"
    r"|(?P<k>class|module|begin|case|do|end|if|unless|while|until|for)(?![\w?!]|:(?!:)))"
)
_RB_VALUE = re.compile(r"(?:(?:^|[\n;=(\[{,|&+\-*/%<>^~:])|(?<!\w)[?!]|(?<![\w.:@$])(?:then|else|do|and|or|not|begin|ensure))[ \t]*\Z")
_RB_GOES_ON = re.compile(r"[=+\-*/%,.&|<>(\[{\\]\s*\Z")
_RB_HEREDOC = re.compile(r"<<[~-]?(['\"]?)[A-Z_]\w*\1")


def _ruby_code(text: str) -> str:
    """Lexed Ruby in which what follows a heredoc's mark on its line stays."""

    def swap(m: re.Match) -> str:
        kind, lines = m.lastgroup, "\n" * m[0].count("\n")
        if kind == "c":
            return lines
        if kind in ("s", "k", "x"):
            return "\x01" + "\x03" * len(lines)
        if mark := _RB_HEREDOC.match(m[0]):
            return "\x01" + Lexed(m[0][mark.end() : m[0].index("\n")], "rb").code.rstrip() + "\x03" * (len(lines) - 1) + "\n"
        return "\x01" + "\x03" * len(lines)

    return LEXERS["rb"].sub(swap, text.replace("\r\n", "\n"))


def _end_lines(text: str) -> list[dict]:
    """Ruby's steps of depth: one up for a word that opens a block, one down for its ``end``.

    ``if`` and the like open where a value may begin and are modifiers elsewhere; the ``do`` of a loop opens nothing; a
    method without ``end`` ends with its expression.
    """
    code = _ruby_code(text) + "\n"
    rows: list[dict] = []
    short: list[tuple[int, int]] = []
    line = seen = depth = level = 0
    loop = False
    for m in _RB_STEP.finditer(code):
        line += code.count("\x03", seen, m.start())
        seen = m.start()
        kind, word = m.lastgroup, m["k"]
        if m["n"] or m["s"]:
            loop = False
            while short and short[-1] == (depth, level) and (m["s"] or not (_RB_GOES_ON.search(code, max(m.start() - 80, 0), m.start()) or code[m.end() : m.end() + 200].lstrip().startswith((".", "&.")))):
                short.pop()
                level -= 1
                rows.append(_step(line, 0))
            line += kind == "n"
        elif m["o"] or m["e"]:
            depth += 1 if m["o"] else -1
        elif m["d"]:
            rows.append(_step(line, 1, m["d"].rpartition(".")[2]))
            level += 1
            if m["l"]:
                short.append((depth, level))
            line += m[0].count("\n")
        elif word == "end":
            level -= 1
            rows.append(_step(line, 0))
        elif word == "do" and loop:
            loop = False
        elif word in ("class", "module", "begin", "case", "do", "for") or _RB_VALUE.search(code, max(m.start() - 80, 0), m.start()):
            level += 1
            rows.append(_step(line, 1))
            loop = word in ("while", "until", "for")
    return rows


def _depth_lines(text: str, language: str) -> list[dict]:
    if language == "py":
        return _indent_lines(text)
    return _end_lines(text) if language == "rb" else _brace_lines(text, language)


def delimited(files: DataFrame) -> DataFrame:
    """(file_path, name, line_start, line_end) of the functions of parsed files, ends exclusive, lines from 0.

    The depth before and after a line is a running sum; a function ends on the first later line whose depth after it is
    not above the depth before its start. That line is found by a window over the rows of one depth level. Python's
    depth is that of its indents, Ruby's that of its blocks; they give a row per step, in order.
    """
    lines = files.select("file", "file_path", F.posexplode("steps").alias("step", "row")).select("file", "file_path", "step", "row.*")
    upto = Window.partitionBy("file").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    depth = lines.withColumn("after", F.sum(F.col("up") - F.col("down")).over(upto)).withColumn("before", F.col("after") - F.col("up") + F.col("down"))
    one_line = (F.col("up") > 0) & (F.col("after") <= F.col("before"))
    level = F.when(F.col("name").isNotNull() & ~one_line, F.col("before")).otherwise(F.col("after"))
    later = Window.partitionBy("file", "level").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    closes: Column = F.min(F.when((F.col("down") > 0) & (F.col("after") < F.col("before")), F.col("line"))).over(later)
    ends = F.when(one_line, F.col("line")).otherwise(closes)
    return (
        depth.withColumn("level", level)
        .withColumn("line_end", (ends + 1).cast("int"))
        .where("name is not null and line_end is not null")
        .select("file_path", "name", F.col("line").alias("line_start"), "line_end")
    )


def delimited_functions(documents: DataFrame, path_column: str = "file_path", text_column: str = "text", languages: frozenset[str] = CODE) -> DataFrame:
    """(file_path, name, line_start, line_end) of the functions of ``languages`` in documents."""
    return delimited(parsed(documents, path_column, text_column, languages))
