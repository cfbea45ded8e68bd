"""Lexers of twelve languages: comments, literals and code of a text, by one compiled pattern per language.

Groups of a match: ``c`` a comment, ``s`` a literal, ``t`` a template or raw literal, ``p`` a preprocessor line, ``k``
other code that may hold a quote (a lifetime, a number with digit marks), ``x`` the start of a literal or comment that
never ends. What no match covers is plain code.
"""

from __future__ import annotations

import re

EXTENSIONS = ("py", "rs", "js", "ts", "go", "java", "c", "cpp", "rb", "json", "toml", "css")

_SLASH = r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};])|(?<=[=(,:\[!&|?{};]\s)|(?<=return\s))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
# After the condition of a statement a slash opens a literal too; the condition is taken along.
_REGEX += r"|\b(?:if|while|for|with)[ \t]*\((?:[^()'\"`/\n]|\([^()'\"`/\n]*\))*\)[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_PREPROCESSOR = r"(?P<p>^[ \t]*#[^\n]*(?:(?<=\\)\n[^\n]*)*)"

_PATTERNS = {
    "py": r"(?P<c>#[^\n]*)|(?P<t>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\x27\x27\x27(?:[^\\]|\\[\s\S])*?\x27\x27\x27))" + f"|(?P<s>[rRbBuUfFtT]{{0,2}}(?:{_DQ}|{_SQ}))|(?P<x>[\"'])",
    "js": rf"(?P<c>//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*)|(?P<s>{_DQ}|{_SQ}|{_REGEX})|(?P<t>`(?:[^`\\]|\\[\s\S])*`)|(?P<x>/\*|[\"'`])",
    "rs": rf"{_SLASH}|(?P<t>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h))|(?P<s>b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|.)|[^'\\\n])')|(?P<k>'[A-Za-z_]\w*)|(?P<x>/\*|[\"'])",
    "go": rf"{_SLASH}|(?P<s>{_DQ}|'(?:\\[^'\n]+|\\'|[^'\\\n])')|(?P<t>`[^`]*`)|(?P<x>/\*|[\"'`])",
    "java": rf"{_SLASH}|(?P<t>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\")|(?P<s>{_DQ}|'(?:\\[^'\n]+|\\'|[^'\\\n])')|(?P<x>/\*|[\"'])",
    "c": rf"{_SLASH}|{_PREPROCESSOR}|(?P<s>{_DQ}|'(?:[^'\\\n]|\\.)+')|(?P<x>/\*|[\"'])",
    "cpp": rf"{_SLASH}|{_PREPROCESSOR}|(?P<t>R\"(?P<h>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=h)\")|(?P<k>\b\d[\w.]*(?:'[0-9a-fA-F][\w.]*)+)|(?P<s>{_DQ}|'(?:[^'\\\n]|\\.)+')|(?P<x>/\*|[\"'])",
    "rb": r"(?P<c>^=begin\b[\s\S]*?^=end[^\n]*|^__END__\s*$[\s\S]*|(?:^|(?<=[\s;(\[{,]))#[^\n]*)"
    r"|(?P<t><<[~-]?(?P<q>['\"]?)(?P<h>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?^\s*(?P=h)[ \t]*$|%[wWiIqQr]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>))"
    r"|(?P<s>\"(?:[^\"\\#]|\\[\s\S]|#(?!\{)|#\{(?:[^{}\"]|\"[^\"]*\"|\{[^}]*\})*\})*\"|'(?:[^'\\]|\\[\s\S])*'|(?:(?<=[=(,~]\s)|(?<=[(,]))/(?:\\.|[^/\\\n])+/[a-z]*)|(?P<k>[\w)\]]\?['\"]?(?=\s))|(?P<x>[\"'])",
    "json": r"(?P<s>\"(?:[^\"\\\n]|\\[^\n])*\")|(?P<x>\")",
    "toml": r"(?P<c>#[^\n]*)|(?P<t>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\x27\x27\x27[\s\S]*?\x27\x27\x27)|(?P<s>\"(?:[^\"\\\n]|\\[^\n])*\"|'[^'\n]*')|(?P<x>[\"'])",
    "css": rf"(?P<c>/\*[\s\S]*?\*/)|(?P<s>{_DQ}|{_SQ}|url\([^\"')\n]*\))|(?P<x>/\*|[\"'])",
}
_PATTERNS["ts"] = _PATTERNS["js"]
LEXERS = {name: re.compile(p, re.M) for name, p in _PATTERNS.items()}

LITERAL, TEMPLATE = "\x01", "\x02"


def extension(path: str | None) -> str:
    """The lower-case extension of a path, '' where there is none."""
    return path.rpartition("/")[2].rpartition(".")[2].lower() if path and "." in path.rpartition("/")[2] else ""


class Lexed:
    """The code of a text with comments taken out and literals made one sign each, and where a literal never ends."""

    __slots__ = ("code", "open_at")

    def __init__(self, text: str, language: str):
        self.open_at = -1

        def swap(m: re.Match) -> str:
            kind = m.lastgroup
            if kind in ("q", "h"):
                kind = "t"
            if kind == "c":
                return "\n" * m[0].count("\n") or " "
            if kind == "s":
                return LITERAL + "\n" * m[0].count("\n")
            if kind == "t":
                return TEMPLATE + "\n" * m[0].count("\n")
            if kind == "x" and self.open_at < 0:
                self.open_at = m.start()
            return m[0]

        self.code = LEXERS[language].sub(swap, text)


_OPEN = {")": "(", "]": "[", "}": "{"}
_BRACKETS = re.compile(r"[()\[\]{}]")


def unbalanced(code: str) -> str | None:
    """Pushdown stack over the delimiters of lexed code: what is wrong with them, or None."""
    stack: list[str] = []
    push, pop = stack.append, stack.pop
    for ch in _BRACKETS.findall(code):
        if ch in "([{":
            push(ch)
        elif not stack or pop() != _OPEN[ch]:
            return "unbalanced"
    return "premature end" if stack else None


def masked(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with literals and comments blanked in place, and the spans of its comments. Offsets stay as they are."""
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        kind = m.lastgroup
        if kind in ("k", "x"):
            return m[0]
        if kind == "c":
            comments.append(m.span())
        return re.sub(r"[^\n]", " ", m[0])

    return LEXERS[language].sub(blank, text), comments
