"""Paths: language by name, source-file filters, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name.
LANGUAGE_EXTENSIONS = {
    "rust": ["rs"],
    "python": ["py", "pyi", "pyx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hxx"],
    "json": ["json"],
    "toml": ["toml"],
    "yaml": ["yaml", "yml"],
    "html": ["html", "htm"],
    "css": ["css", "scss"],
    "ruby": ["rb"],
    "bash": ["sh", "bash", "zsh"],
}
LANGUAGE_NAMES = {"makefile": "bash", "gnumakefile": "bash", "dockerfile": "bash"}
LANGUAGE_OF = {e: language for language, all_ in LANGUAGE_EXTENSIONS.items() for e in all_}
CONFIG_LANGUAGES = ("json", "toml", "yaml", "html", "css", "bash")

# What counts as a source file, and what the watcher takes.
SOURCE_NAMES = ["makefile", "dockerfile", "rakefile", "gemfile", "cmakelists.txt"]
SOURCE_EXTENSIONS = (
    "rs py pyi pyx js jsx mjs cjs ts tsx mts cts go java kt kts c h cc cpp cxx hpp hxx cs rb php swift scala sh bash zsh fish "
    "html htm css scss sass less json yaml yml toml xml ini cfg md rst txt sql lua dart ex exs erl hs ml mli zig proto dockerfile makefile"
).split()
WATCHED_EXTENSIONS = "rs py js jsx ts tsx go java c cpp h hpp rb sh bash json toml yaml yml html css".split()
MAX_FILE_SIZE = 10 * 1024 * 1024


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null where nothing does, or where the dot is the first sign."""
    name = file_name(path)
    return F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1), F.lit(""))


def language(path: Column) -> Column:
    """The language of a path: by its file name, then by its extension, whatever the case; null if unknown."""
    by_name = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    by_extension = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(by_name, F.lower(file_name(path))), F.try_element_at(by_extension, F.lower(extension(path))))


def is_source_file(path: Column) -> Column:
    """Whether the name or the extension is that of source text, whatever the case."""
    return F.lower(file_name(path)).isin(SOURCE_NAMES) | F.coalesce(F.lower(extension(path)).isin(SOURCE_EXTENSIONS), F.lit(False))


def should_index(path: Column, size: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """Whether a file is a source file of at most ``max_size`` bytes. Its content is another question."""
    return (size <= max_size) & is_source_file(path)


def is_watched(path: Column) -> Column:
    """The watcher's narrower, case-sensitive list of extensions."""
    return F.coalesce(extension(path).isin(WATCHED_EXTENSIONS), F.lit(False))


def is_binary(content: Column) -> Column:
    """Whether more than one byte in a hundred of the first 8 KiB is zero. Empty content is text."""
    head = F.substring(content, 1, 8192)
    size = F.octet_length(head)
    zeros = size - F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "\\x00", ""))
    return F.when(size > 0, zeros / size > 0.01).otherwise(False)


def glob_regex(glob: str) -> str:
    """The regular expression of an exclusion glob; without a slash it holds for the name in any directory."""
    body, out, i = glob.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif body[i] == "{" and (end := body.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(re.escape(x) for x in body[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = "^(?:.*/)?" if "/" not in glob.strip("/") else "^"
    return f"{start}{out}(?:/.*)?$"


def is_excluded(path: Column, globs: list[str]) -> Column:
    """Whether any exclusion glob holds for a path relative to the root."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regex, ignored) of an ignore file's lines, in order; a leading ! takes a path back in."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        taken_back = line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        anchored = "/" in line.rstrip("/")
        rules.append((glob_regex(("/" if anchored else "") + line.strip("/")) if not anchored else "^" + glob_regex("**/" + line.strip("/")).removeprefix("^").removeprefix("(?:.*/)?"), not taken_back))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The verdict of the last rule that holds for a path; not ignored if none does."""
    verdict = F.lit(False)
    for rx, ignored in rules:
        verdict = F.when(path.rlike(rx), F.lit(ignored)).otherwise(verdict)
    return verdict
