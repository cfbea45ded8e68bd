r"""Source files that do not parse, per file, with rates per project and language.

A lexer of the language finds literals and comments that never end; a pushdown stack over the remaining delimiters finds
unbalanced ones and premature ends (of C, each branch of a conditional counts once, and what directives hold does not
count); a stack of indents does so for Python's blocks, and one of the grammar's states for JSON. The states of adjacent
tokens show operators without an operand and operands without an operator. Merge-conflict markers, stray patch hunks,
block keywords without their ``end``, and statements that the language's grammar has no place for (mostly another
language's, under a wrong extension) are looked for in the lexed code. Python, JSON and TOML are also read by the standard
library's parser, an exact check: it decides, and the steps before it say what is wrong.

Cases: a null or blank text and an extension outside the twelve languages give no verdict; CRLF, a missing final newline
and a leading byte-order mark are no faults; very long texts are read whole; repeated rows each get their row; a table
without rows gives none.
"""

from __future__ import annotations

import ast
import json
import keyword
import re
import tomllib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.lexers import LEXERS, LITERAL, Lexed, extension, unbalanced

#: Extension to the name of its language.
LANGUAGES = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "rb": "ruby", "json": "json", "toml": "toml", "css": "css"}

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: [^\n]*)?$", re.M)
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@", re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)", re.M)
_DIRECTIVES = {"", "define", "undef", "include", "include_next", "import", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif", "pragma", "error", "warning", "line", "embed"}

# Reserved words after which, or before which, another word may stand.
_WORDS = {
    "js": "var let const function async await class extends new return typeof void delete throw case import export default from as of in instanceof if else for while do switch try catch finally yield static get set break continue debugger with this super using",
    "rs": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type union unsafe use where while yield default macro_rules box auto",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits yield non module requires exports opens uses provides with to",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool size_t _Bool _Static_assert _Noreturn __attribute__ asm",
}
_WORDS["ts"] = _WORDS["js"] + " type interface enum namespace module declare abstract public private protected readonly implements keyof is infer satisfies unique asserts override accessor out global require"
_WORDS["cpp"] = _WORDS["c"] + " class public private protected virtual override final new delete operator template typename namespace using friend explicit constexpr consteval constinit noexcept mutable this throw try catch and or not xor concept requires co_await co_return co_yield decltype static_assert thread_local export import module wchar_t"


_WORDS["rb"] = "do then if unless and or not rescue end in while until def class module begin case for when yield return puts require include extend attr_reader attr_accessor raise super self nil true false alias undef redo retry break next ensure else elsif private public protected lambda proc defined print p loop"
_WORDS["py"] = " ".join((*keyword.kwlist, *keyword.softkwlist))
_RESERVED = {k: frozenset(v.split()) for k, v in _WORDS.items()}
#: So many words in a row, none of them reserved, stand nowhere in the language.
_RUN_LENGTH = {"py": 2, "js": 2, "ts": 2, "rs": 2, "go": 3, "java": 3, "c": 3, "cpp": 3, "rb": 3}
_RUN = re.compile(r"(?<![\w$.@#'\x01\x02:])[A-Za-z_$][\w$]*(?:[ \t]+[A-Za-z_$][\w$]*)+")


def _words_in_a_row(code: str, language: str) -> bool:
    reserved, most = _RESERVED[language], _RUN_LENGTH[language]
    for run in _RUN.findall(code):
        free = 0
        for word in run.split():
            free = 0 if word in reserved else free + 1
            if free == most:
                return True
    return False


_AFTER_LITERAL = r"\x01[ \t]*(?!(?:in|of|instanceof|as|from|satisfies|with|assert|if|unless|and|or|do|then|while|until|rescue|is|not|for|else)\b)[A-Za-z_]"
_COLON_BLOCK = r"^[ \t]*(?:def|class|if|elif|else|for|while|try|except|finally|with)\b[^{};?\n]*:[ \t]*$"
_ELISION = r"^[ \t]*\.\.\.[ \t]+[\w(]"

#: What the statements of a language never look like, in lexed code.
_NEVER = {
    "js": [
        _AFTER_LITERAL, r":=", r"(?<![\w)\]>-])->|[\w)\]][ \t]*->", r"::", r"^[ \t]*#(?![A-Za-z_$!])", r"^[ \t]*#\[", r"^[ \t]*(?:package|use|pub|fn|func|def|impl|struct|trait|mod|match|elif|unless|require_relative|defer|goto|namespace|template|typedef)[ \t]+[\w\"(]",
        r"^[ \t]*end[ \t]*$", r"^[ \t]*import[ \t]+[\w.]+[ \t]*;", _COLON_BLOCK, r"^[ \t]*(?:const|static)?[ \t]*(?:int|long|double|float|char|short|unsigned|boolean|bool|void)[ \t]+\**[A-Za-z_]", r"^[ \t]*(?:public|private|protected)[ \t]", r"[\w\]][ \t]*\*[ \t]*\)[ \t]*[{;]", r"!\(", r"^[ \t]*@\w+[ \t]*$(?=\n[ \t]*(?:public|private|protected|static|int|long|void))",
        r"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:interface|enum|type)[ \t]+[A-Za-z_$][\w$]*[ \t]*(?:<[^>\n]*>)?[ \t]*[={]", r"^[ \t]*import[ \t]+type\b", r"\b(?:const|let|var)[ \t]+[\w$]+[ \t]*:[ \t]*\w", r"\bfunction\b[ \t]*[\w$]*[ \t]*\([^()\n]*[\w$][ \t]*\??:[ \t]*\w", r"^[ \t]*[\w$]+[ \t]*\([^()\n?]*\)[ \t]*:[ \t]*[\w\[\]<>|, ]+[ \t]*\{", r"\bfunction\b[ \t]*[\w$]*[ \t]*\([^()\n]*\)[ \t]*:[ \t]*\w",
    ],
    "ts": [
        _AFTER_LITERAL, r":=", r"[\w)\]][ \t]*->", r"::", r"^[ \t]*#(?![A-Za-z_$!])", r"^[ \t]*#\[", r"^[ \t]*(?:package|use|pub|fn|func|def|impl|struct|trait|mod|match|elif|unless|require_relative|defer|goto|template|typedef)[ \t]+[\w\"(]",
        r"^[ \t]*end[ \t]*$", r"^[ \t]*import[ \t]+[\w.]+[ \t]*;", _COLON_BLOCK, r"^[ \t]*(?:const|static)?[ \t]*(?:int|long|double|float|char|short|unsigned|bool|void)[ \t]+\**[A-Za-z_]", r"[\w\]][ \t]*\*[ \t]*\)[ \t]*[{;]", r"[A-Za-z_]!\(\w", r"^[ \t]*(?:public|private|protected)[ \t]+(?:static[ \t]+)?(?:final[ \t]+)?(?:class|int|long|double|void|boolean|String)[ \t]",
    ],
    "rs": [
        r"[\x01][ \t]*(?!as\b|if\b|else\b|in\b)[A-Za-z_]", r":=", r"===|!==|\+\+[ \t]*[;)]|(?<![\w)])--[A-Za-z_]", r"^[ \t]*(?:package|import|func|def|class|var|function|namespace|template|typedef|elif|unless|require|require_relative|defer|goto|try|switch|case|int|long|double|float|void|public|private|protected|interface|export|from|new|throw|begin|rescue|except|with|module|unsigned|final)\b[ \t]*[\w\"({*\x01]",
        r"^[ \t]*end[ \t]*$", r"^[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|endif|pragma)", r"^[ \t]*default[ \t]*:", _COLON_BLOCK, r"^[ \t]*(?:const|let|static)[ \t]+(?:char|int|long|double)\b", r"=>[ \t]*\{[ \t]*$(?=\n[ \t]*(?:var|const|return [\w.]+;\n\}\)))", r"->\w+\[", r"^[ \t]*(?:pub[ \t]+)?(?:fn|struct|enum|mod|trait|impl)[ \t]*$", r"^[ \t]*#(?![!\[])", r"\bnull\b[ \t]*[;){]",
    ],
    "go": [
        r"[\x01][ \t]*[A-Za-z_]", r"===|!==|=>|::|(?<!<)->", r"^[ \t]*#", r"^[ \t]*(?:def|fn|pub|let|use|impl|class|function|public|private|protected|static|namespace|template|typedef|elif|unless|require|require_relative|while|try|catch|do|until|export|from|int|long|double|float|char|void|unsigned|enum|trait|mod|match|begin|rescue|except|with|module|end|async|await|throw|new|extends|include|using|final|abstract)\b[ \t]*(?:[\w({*\x01:]|$)", r"\}[ \t]*(?:catch|while)\b", r"^[ \t]*\}[ \t]*\n+[ \t]*else\b", r"^[ \t]*@\w", _COLON_BLOCK, r"\bfor[ \t]*\(", r"^[ \t]*const[ \t]+(?:char|int|long|double|auto)\b[ \t]*[*&]?[ \t]*\w+[ \t]*=", r"^[ \t]*const[ \t]+[\[{]", r"\bif[ \t]+[^{\n]*\bis\b[^{\n]*:", r"[A-Za-z_]!\(", r"\)[ \t]*:[ \t]*[\w\[\]]+[ \t]*\{", r"<\w+>[ \t]+\w+[ \t]*=",
    ],
    "java": [
        r"[\x01][ \t]*[A-Za-z_]", r":=|===|!==|=>|^[ \t]*#", r"^[ \t]*(?:def|fn|func|pub|let|use|impl|function|const|namespace|template|typedef|elif|unless|require|require_relative|struct|trait|mod|match|defer|goto|range|type|export|from|begin|rescue|except|end|unsafe|async|await|include|using|auto|unsigned|until|extern|print|puts|raise|del|nil|None|self)\b[ \t]*(?:[\w({*\x01:.;]|$)", _COLON_BLOCK, r"\w->\w", r"[\w)]&[ \t]*\w+[ \t]*[,)]", r"\bconst[ \t]", r"\bchar[ \t]*\*", r"[A-Za-z_]!\(", r"^[ \t]*(?:var|int|long)[ \t]+\w+[ \t]*:[ \t]", r"\)[ \t]*:[ \t]*\w+[ \t]*\{", r"\bsizeof[ \t]*\(", r"^[ \t]*package[ \t]+[\w.]+[ \t]*$", r"^[ \t]*import[ \t]+[\w.*]+[ \t]*$", r"^[ \t]*import[ \t]*[{\x01(]",
    ],
    "c": [
        r"[\x01][ \t]*(?!PRI|SCN)[a-z_]", r":=|===|!==|=>|::|(?:^|[\s(,])&mut\b", r"^[ \t]*(?:def|fn|func|pub|let|use|impl|function|namespace|template|elif|unless|require|require_relative|trait|mod|match|defer|range|type|export|from|begin|rescue|except|end|unsafe|async|await|class|package|import|public|private|protected|using|try|catch|with|interface|module|var|new|abstract|final|extends|raise|print|puts|until|throw)\b[ \t]*(?:[\w({*\x01:.;<]|$)", _COLON_BLOCK, r"^[ \t]*@\w", r"\)[ \t]*->", r"\b(?:std|self|nullptr)\b[ \t]*::", r"\bauto[ \t]*&", r"\[[=&\]]*\][ \t]*\([^)\n]*\)[ \t]*\{", r"[\w>][ \t]*&[ \t]*\w+[ \t]*[,)][^;\n]*\{", r"[A-Za-z_]!\(\w", r"\b(?:vector|map|unique_ptr|shared_ptr|List|Vec|Option|Result)<", r"\)[ \t]*:[ \t]*\w+[ \t]*\{", r"\bfor[ \t]+\w", r"\b(?:if|while|switch)[ \t]+[\w!]", r"\bnew[ \t]+\w+[(<\[]",
    ],
    "cpp": [
        r"[\x01][ \t]*(?!PRI|SCN|s\b|sv\b|_)[a-z_]", r":=|===|!==|=>[ \t]*[\w{(]|(?:^|[\s(,])&mut\b", r"^[ \t]*(?:def|fn|func|pub|let|use|impl|function|elif|unless|require|require_relative|trait|mod|match|defer|range|type|from|begin|rescue|except|end|unsafe|async|await|package|with|interface|var|extends|raise|print|puts|until)\b[ \t]*(?:[\w({*\x01:.;<]|$)", _COLON_BLOCK.replace("class|", "").replace("else|", ""), r"^[ \t]*@\w", r"^[ \t]*(?:export[ \t]+)?import[ \t]+[\w.*{]+[^<;\n]*$", r"^[ \t]*import[ \t]+\w+\.[\w.]+;", r"^[ \t]*(?:public|private|protected)[ \t]+(?:static|final|class|int|long|void|double|String|boolean)\b", r"[A-Za-z_]!\(\w", r"\bfor[ \t]+\w", r"\b(?:if|while|switch)[ \t]+[\w!](?!onstexpr|onsteval)", r"\)[ \t]*:[ \t]*\w+[ \t]*\{[ \t]*$(?<!\))", r"\bnew[ \t]+\w+<>\(",
    ],
    "rb": [
        r"^[ \t]*[\w$.]+[ \t]*:=", r"===[ \t]*null|!==", r"^[ \t]*(?:fn|func|pub|let|use|impl|function|const|var|namespace|template|typedef|elif|struct|trait|mod|match|defer|goto|range|type|export|from|except|async|await|package|import|public|private|protected|static|final|int|long|double|float|char|void|unsigned|enum|interface|switch|try|catch|using|new|throw|with|default)\b[ \t]+[\w\"({*\x01\[&]", r"[;{][ \t]*\n[ \t]*(?:int|long|return)\b", r"^[ \t]*(?:if|while|for|switch|else[ \t]+if)[ \t]*\(.*\)[ \t]*\{[ \t]*$", r"^[ \t]*\}[ \t]*(?:else|catch|finally|while)\b", r"^[ \t]*(?:break|continue)[ \t]*;", r"^[ \t]*(?:try|else|do|finally)[ \t]*\{[ \t]*$", r"^[ \t]*//|/\*|\*/", r"^[ \t]*default[ \t]*:", r"^[ \t]*@\w+[ \t]*$", r"\)[ \t]*(?:->|:)[ \t]*[\w<\[&]+.*\{[ \t]*$", r"^[ \t]*(?:def|class|if|elif|for|while|try|except|with)\b[^{};?\n|]*[\w)\]][ \t]*:[ \t]*$", r"[A-Za-z_]!\(\w+[^)\n]*\x01\);", r"\w->\w+\[", r"^[ \t]*#", 
    ],
    "css": [r"^[ \t]*(?:def|fn|func|function|class|package|use|pub|import|const|let|var|return|if|for|while|public|struct|#include)[ \t]+[\w\"'({]", r"=>|:=|==|\+=", r"[^{}:;,]*;[^{}]*\{[^{}]*\{[^{}]*\{[^{}]*\{"],
}


def _split(patterns: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """One pattern for what stands at the start of a line, one for the rest: two quick scans instead of many."""
    start = r"^[ \t]*"
    anchored = [p[len(start) :] for p in [*patterns, _ELISION] if p.startswith(start)]
    free = [p for p in patterns if not p.startswith(start)]
    return re.compile(start + "(?:" + "|".join(f"(?:{p})" for p in anchored) + ")", re.M), re.compile("|".join(f"(?:{p})" for p in free), re.M)


_NEVER_RX = {k: _split(v) for k, v in _NEVER.items()}

_STATEMENT_END = {
    "java": re.compile(r"^[ \t]*(?![@}]|case\b|default\b|else\b|do\b|try\b|finally\b|if\b|while\b|for\b|switch\b|(?:public|private|protected|static|final|abstract|class|interface|enum|synchronized)\b)[^\n;{}]*[\w)\]\x01][ \t]*\n+[ \t]*(?:[A-Za-z_][\w.]*[ \t]*(?:[-+*/]?=[^=]|\(|\+\+|<[\w, ]*>[ \t]+\w)|(?:return|for|while|if|switch|try|break|continue|long|int|String|char|double|boolean)\b|[}])", re.M),
    "c": re.compile(r"^[ \t]*(?![#}]|case\b|default\b|else\b|do\b|if\b|while\b|for\b|switch\b|static\b|enum\b|struct\b|typedef\b|extern\b)[^\n;{}:,]*[\w)\]\x01][ \t]*\n+[ \t]*(?:[a-z_][\w.]*[ \t]*(?:[-+*/]?=[^=]|\+\+)|(?:return|for|while|if|switch|break|continue|goto)\b|[}])", re.M),
}
_STATEMENT_END["cpp"] = re.compile(_STATEMENT_END["c"].pattern.replace("|switch\\b|static", "|switch\\b|try\\b|class\\b|namespace\\b|template\\b|public\\b|private\\b|protected\\b|static"), re.M)

_GO_TOP = re.compile(r"^(?!package\b|import\b|func\b|type\b|var\b|const\b|[\s)}\]\x02]|$|\x01)", re.M)
_RB_OPEN = re.compile(r"^[ \t]*(?:class|module|def|begin|if|unless|while|until|case|for)\b|=[ \t]*(?:if|unless|case|begin|while)\b|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)", re.M)
_RB_LOOP_DO = re.compile(r"^[ \t]*(?:while|until|for)\b[^\n]*\bdo[ \t]*$", re.M)
_RB_ENDLESS = re.compile(r"^[ \t]*def[ \t]+[\w.?!]+(?:\([^)\n]*\))?[ \t]*=[^=~>]", re.M)
_RB_END = re.compile(r"(?<![\w.:])end\b(?![?!:\w])")


_BRANCH = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b([^\n]*)", re.M)
_ANY_DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*(?:(?<=\\)\n[^\n]*)*", re.M)


def _one_branch(code: str) -> str:
    """Code of C without directives and with the first live branch of each conditional alone."""
    pieces, at, skip, depth = [], 0, 0, 0
    for m in _BRANCH.finditer(code):
        word, dead = m[1], m[2].strip() == "0"
        if word.startswith("if"):
            depth += 1
            if not skip and word == "if" and dead:
                pieces.append(code[at : m.start()])
                skip = depth
        elif word == "endif":
            if skip == depth:
                skip, at = 0, m.start()
            depth -= 1
        elif skip == 0:
            pieces.append(code[at : m.start()])
            skip = depth
    if not skip:
        pieces.append(code[at:])
    return _ANY_DIRECTIVE.sub("", "".join(pieces))


# Operators that stand between two operands and nowhere else; signs that have other uses in a language are left out there.
_BETWEEN = r"(?:(?<!\+)\+(?!\+)|(?<![*/])/(?![/*>])|%|\^|(?<!operator)[=!]=|<=(?!>)|>=(?!=)|(?<![\w.]operator)(?<![=!<>:+\-*/%&|^.~?\[])=(?![=>~])|[-+*/%|^]=)"
_CLOSER_AFTER = re.compile(_BETWEEN + r"[ \t]*(?:\n[ \t]*)*[)\];,]")
_OPENER_BEFORE = re.compile(r"[(\[,][ \t]*(?:%(?![\w(])|[=!]=|>=|=(?![=>\]&,~]))")
_NO_VALUE = re.compile(r"(?:^|[;{])[ \t\n]*(?!--)[\w-]+[ \t]*:[ \t]*(?=[;}])")
#: Languages whose tokens' states are looked at.
_STATES = frozenset(("js", "ts", "rs", "go", "java", "c", "cpp"))


def _operands(code: str, language: str) -> str | None:
    """The states of adjacent tokens: an operator without its operand, or operands without an operator between."""
    if language == "css":
        return "missing operand" if _NO_VALUE.search(code) else None
    if language in _STATES and (_CLOSER_AFTER.search(code) or _OPENER_BEFORE.search(code)):
        return "missing operand"
    if language in _RUN_LENGTH and _words_in_a_row(code, language):
        return "missing operator"
    return None


def _statements(code: str, language: str) -> str | None:
    """What lexed code holds that the grammar of the language has no place for."""
    if language == "go":
        body = code.lstrip()
        if not body.startswith("package"):
            return "no package clause"
        if _GO_TOP.search(code):
            return "foreign statement"
    if language == "rb":
        opens = len(_RB_OPEN.findall(code)) - len(_RB_LOOP_DO.findall(code)) - len(_RB_ENDLESS.findall(code))
        if opens != len(_RB_END.findall(code)):
            return "block without end"
    if found := _operands(code, language):
        return found
    at_start, anywhere = _NEVER_RX[language]
    if at_start.search(code) or anywhere.search(code):
        return "foreign statement"
    if (rx := _STATEMENT_END.get(language)) and rx.search(code):
        return "statement without end"
    return None


def _directives(code: str) -> str | None:
    """Unknown or unbalanced directives of C."""
    depth = 0
    for m in _DIRECTIVE.finditer(code):
        if m[1] not in _DIRECTIVES:
            return "foreign statement"
        depth += m[1] in ("if", "ifdef", "ifndef")
        depth -= m[1] == "endif"
    return "unbalanced directive" if depth else None


_PY_SIGN = re.compile(r"[()\[\]{}\n]")


def _indents(text: str) -> str | None:
    """Python's blocks by a stack of indents over logical lines."""

    def swap(m: re.Match) -> str:
        return "" if m.lastgroup == "c" else LITERAL

    code = LEXERS["py"].sub(swap, text).replace("\\\n", " ") + "\n"
    indents, opened, depth, at = [0], False, 0, 0
    for m in _PY_SIGN.finditer(code):
        if m[0] != "\n":
            depth += 1 if m[0] in "([{" else -1
            continue
        if depth > 0:
            continue
        line, at = code[at : m.start()], m.end()
        if not (bare := line.strip()):
            continue
        indent = len(line[: len(line) - len(line.lstrip())].rpartition("\f")[2].expandtabs(8))
        if opened:
            if indent <= indents[-1]:
                return "block without body"
            indents.append(indent)
        elif indent > indents[-1]:
            return "unexpected indent"
        while indent < indents[-1]:
            indents.pop()
        if indent != indents[-1]:
            return "uneven indent"
        opened = bare.endswith(":")
    return "premature end" if opened else None


_JSON_TOKEN = re.compile(r"[{}\[\],:]|\x01|-?[0-9][0-9.eE+-]*|true\b|false\b|null\b|[^\s]")
_PY_FOREIGN = re.compile(r"^[ \t]*(?://|\.\.\.[ \t]*[\w(])|::|;[ \t]*\n[ \t]*[{}]", re.M)
_TOML_NO_VALUE = re.compile(r"=[ \t]*(?:\n|\Z)")


def _json_states(code: str) -> str | None:
    """JSON's grammar as a pushdown automaton: the stack holds what is open, the state what may come next."""
    stack: list[str] = []
    state = "value"
    for token in _JSON_TOKEN.findall(code):
        if token == "}" and stack and stack[-1] == "{" and state in ("key or end", "next") or token == "]" and stack and stack[-1] == "[" and state in ("value or end", "next"):
            stack.pop()
            state = "next" if stack else "done"
        elif token in ("{", "["):
            if not state.startswith("value"):
                return "missing operator"
            stack.append(token)
            state = "key or end" if token == "{" else "value or end"
        elif token == "," and state == "next":
            state = "key" if stack[-1] == "{" else "value"
        elif token == ":" and state == "colon":
            state = "value"
        elif token == LITERAL and state.startswith("key"):
            state = "colon"
        elif state.startswith("value") and (token == LITERAL or token[0] in "-0123456789" or len(token) > 1):
            state = "next" if stack else "done"
        else:
            return "missing operand" if token in ("}", "]", ",", ":") else "missing operator"
    return None if state == "done" else "premature end"


def _said(text: str, code: str, language: str) -> str | None:
    """What the automata say of a text that a parser refused."""
    if language == "json":
        return _json_states(code)
    if language == "toml":
        return "missing operand" if _TOML_NO_VALUE.search(code) else None
    if _PY_FOREIGN.search(code):
        return "foreign statement"
    return _indents(text) or ("missing operator" if _words_in_a_row(code, "py") else None)


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _parse(text: str, language: str) -> None:
    """Raises SyntaxError or ValueError where the language refuses the text."""
    if language == "py":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    elif language == "json":
        json.loads(text, parse_constant=_refuse)
    elif language == "toml":
        tomllib.loads(text.replace("\r\n", "\n"))


_TOKENS = {k: re.compile(r"(?P<open>[(\[{])|(?P<close>[)\]}])|" + LEXERS[k].pattern, re.M) for k in ("py", "json", "toml")}
#: Brackets up to this depth are left: those of Python's statements and TOML's table headers stand no deeper.
_OUTER = {"py": 10, "json": 0, "toml": 2}
_LAST = re.compile(r"([^\W\d]\w*|[\w\"')\]}])?(?:[ \t\f\n]|\\\n|#[^\n]*\n)*\Z")
_OPERANDS = frozenset(("True", "False", "None"))
_SIGNS = re.compile(r"([-+~])(?:[ \t]*[-+~])+(?![=>])|\b(not)(?:[ \t]+not\b)+")


def _group(text: str, before: str, language: str) -> str:
    """A short text that may stand for a bracketed one without inner brackets; raises where that is refused."""
    if language != "py":
        _parse(text if language == "json" else f"x = {text}", language)
        return "0"
    word = _LAST.search(before)[1]
    if word == "for":
        _parse(f"[0 for {text} in _]", language)
        return "_"
    if word and (word in _OPERANDS or not keyword.iskeyword(word)) and text[0] != "{":
        _parse(f"(_{text})", language)
        return "()" if text[0] == "(" else "[_]"
    _parse(f"({text})", language)
    return "_"


def _flat(text: str, language: str) -> str:
    """The text with deep brackets judged from the inside out, without recursion, each giving way to a short text."""
    pieces: list[list[str]] = [[]]
    at = 0
    for m in _TOKENS[language].finditer(text):
        if m["open"]:
            pieces[-1].append(text[at : m.start()])
            pieces.append([])
            at = m.start()
        elif m["close"]:
            inner = "".join(pieces.pop()) + text[at : m.end()]
            at = m.end()
            if len(pieces) > _OUTER[language]:
                inner = _group(inner, "".join(pieces[-1][-2:])[-200:], language)
            pieces[-1].append(inner)
    flat = "".join(pieces[0]) + text[at:]
    return _SIGNS.sub(lambda m: m[1] or m[2], flat) if language == "py" else flat


def _parser(text: str, language: str) -> str | None:
    """The verdict of the standard library's parser, for the languages that have one.

    A text too deep for it is made flat first. RecursionError from Python's parser comes after the text was accepted, when
    the tree is handed over. What overflows Python's parser even when flat gives no fault.
    """
    try:
        try:
            _parse(text, language)
        except (RecursionError, MemoryError) as e:
            if language != "py" or isinstance(e, MemoryError):
                _parse(_flat(text, language), language)
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return "rejected by the parser"
    return None


def fault(text: str | None, language: str) -> str | None:
    """What is wrong with a text in the language of extension ``language``; None if nothing is."""
    if text is None or not text.strip() or language not in LANGUAGES:
        return None
    text = text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    lexed = Lexed(text, language)
    if lexed.open_at >= 0:
        return "unterminated literal"
    code = lexed.code
    if _CONFLICT.search(code):
        return "merge conflict"
    if language != "css" and _HUNK.search(code):
        return "patch hunk"
    if language in ("c", "cpp"):
        if wrong := _directives(code):
            return wrong
        code = _one_branch(code)
    if wrong := unbalanced(code):
        return wrong
    if language not in ("py", "json", "toml"):
        return _statements(code, language)
    refused = _parser(text, language)
    return refused and (_said(text, code, language) or refused)


def parse_faults(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """The ``keep`` columns, language and fault (null: sound) of every non-blank text of a known language. No shuffle."""
    columns = [documents[c] for c in keep]
    source = documents.select(*columns, documents[path_column].alias("_path"), documents[text_column].alias("_text"))
    schema = source.drop("_path", "_text").schema.add("language", "string").add("fault", "string")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, languages, faults = [], [], []
            for i, (path, text) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                language = extension(path)
                if text is None or language not in LANGUAGES or not text.strip():
                    continue
                rows.append(i)
                languages.append(LANGUAGES[language])
                faults.append(fault(text, language))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(n)), pa.array(languages, pa.string()), pa.array(faults, pa.string())], names=[*keep, "language", "fault"])

    return source.mapInArrow(run, schema)


def fault_rates(faults: DataFrame) -> DataFrame:
    """(project, language, files, faulty, rate): pre-aggregated, so a project with a third of the files is no hot key."""
    return (
        faults.groupBy("project", "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("fault").alias("faulty"))
        .withColumn("rate", F.round(F.col("faulty") / F.col("files"), 6))
    )
