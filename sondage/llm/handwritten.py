"""Generated, minified or vendored source files, so that only hand-written source remains.

Repositories may declare such paths in attribute files; those are parsed and resolved as the tool that reads them does:
within a file the last matching line holds, and a file in a deeper directory goes before one further up. Undeclared
repositories get equivalent patterns, mined from the collection itself: directory names, parts and shapes of file names
that stand on files with a sign far more often than on others, in several projects; a handful of conventions that hold
everywhere stands in where a collection is too small to mine. A sign is a comment (never a string) that says the file is
generated or vendored, or the shape of the text: minified lines, bulk data, accessor tables.

Cases: a null or blank text is no case; a null path has no sign in the path; an explicit negative declaration goes before
every pattern; comments are read in their visually consistent form; very long texts are read whole; repeated rows each
get their row; without attribute files, or in an empty table, the patterns are all there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.lexers import LEXERS, LITERAL, Lexed, extension
from sondage.llm.visual_form import one_form
from sondage.operators.directory_rules import ruled
from sondage.storage import written

# The few conventions that hold everywhere, for collections too small to mine.
STANDARD_PATHS = [
    r"(?:^|/)(?:vendor(?:ed|s)?|(?:3rd|third)[-_]?party|node_modules|bower_components|site-packages|generated|__generated__)/",
    r"[._-]min\.\w+$|[._-]generated\.\w+$|\.pb(?:\.\w+)?\.\w+$|_pb2?\.\w+$",
    r"(?:^|/)(?:package-lock|npm-shrinkwrap)\.json$|\.lock(?:\.\w+)?$",
]
_STANDARD = re.compile("|".join(f"(?:{p})" for p in STANDARD_PATHS), re.I)

# What generators, and people who copy, write about a file: how it was made, that it is not to be edited, what
# becomes of edits, where it was copied from. In English and, for the two commonest sentences, a few other languages.
GENERATED_SIGNS = [
    r"@generated\b|<\s*auto-?generated\b",
    r"\b(?:auto(?:matically)?|machine)[ -]?(?:generated|produced|created|written)\b(?!\s+(?:clients?|tables?|names?|keys?|ids?|docs?)\b(?! by| from| with))",
    r"\b(?:do not|don['’]?t|never|must not|should not)(?: be)? (?:manually |hand[- ]?)?(?:edit|modif|change|touch|alter)\w*\b(?! (?:this|the) (?:list|order|value|line|table|constant|key|default))",
    r"\b(?:edits?|changes|modifications)\b[^.;]{0,30}\b(?:(?:will|would|get|gets|are|is|be) (?:be )?(?:lost|overwritten|discarded|undone))\b",
    r"(?:^|\b(?:this|the) )(?:whole )?(?:code|file|source|module|class|bindings?|parser|lexer|content|document)?(?:(?: is| was| has been) | ?)(?:a )?(?:generated|produced|derived|compiled|emitted) (?:automatically|by|from|with|using|file|output)\b",
    r"\bproduced by [\w./-]+ (?:from|out of)\b|\bedit \S+ instead\b|\bre-?generate(?:d)? (?:it |this |this file )?(?:with|by|using)\b",
    r"automatisch (?:erzeugt|erstellt|generiert)|nicht (?:von hand )?(?:bearbeiten|ändern|editieren)|(?:produit|généré|créé)\w* automatiquement|ne pas (?:modifier|éditer)|(?:generad|cread)o (?:automáticamente|por )|no (?:editar|modificar)\b|gerado automaticamente|não (?:edit|modifi)|generato automaticamente|non modificare",
    r"автоматически (?:создан|с?генерирован)|(?:создан|с?генерирован)\w* автоматически|не (?:редактир|изменя)|自動生成|自动生成|編集しない|请勿(?:修改|编辑)|자동 ?생성",
]
VENDORED_SIGNS = [
    r"^(?:vendored|vendored code|upstream)\s*[:@]\s*\S+ (?:at\b|@|tag\b|release\b|version\b|v?\d)|\bvendored (?:from|in from|copy of)\b|^(?:imported |bundled |vendored )third[- ]party (?:code|source|copy|library)\b",
    r"\b(?:copied|taken|imported|mirrored|kopiert|übernommen|copié|copiado) (?:verbatim |unchanged |unmodified |over |as is )?(?:from|aus|de|desde) \S+ (?:release|version|versión|versão|tag|v?\d)",
    r"\b(?:bundled|vendored|verbatim|unmodified|embedded) copy of\b",
]
_SIGN = re.compile("|".join(f"(?:{p})" for p in [*GENERATED_SIGNS, *VENDORED_SIGNS]), re.I | re.M)
_BANNER = re.compile(r"^/\*!\s*\*?\s*[\w.@/-]+(?:\.js|\.css)?\s+v?\d+\.\d+", re.M)
_SOURCE_MAP = re.compile(r"^(?://|/\*)[#@]\s*sourceMappingURL=", re.M)
# One of these stands in every text that a sign matches; a quick test before the lexer.
_HINT_WORDS = "generated generate_ machine auto-produced auto_produced automatically autocreated auto-created auto_created autowritten auto-written auto_written produced derived compiled emitted instead overwritten discarded undone do_not don't don’t never_edit never_modif never_change never_touch never_alter never_be_ never_hand never_manually must_not should_not are_lost be_lost get_lost gets_lost is_lost erzeugt erstellt generier bearbeiten ändern editieren automatiquement modifier éditer automáticamente creado_por generado_por creada_por generada_por no_editar no_modificar gerado não_edit não_modif generato modificare автоматически редактир изменя 生成 編集 编辑 修改 생성 vendored upstream third-party third_party copied_from copied_verbatim copied_unchanged copied_unmodified copied_over copied_as taken_ imported_ mirrored kopiert übernommen copié_ copiado copy_of"
_HINTS = tuple(h.replace("_", " ") for h in _HINT_WORDS.split())
_DIGITS = "0123456789,"
_LONG_WORD = re.compile(r"[A-Za-z0-9+/=_\\-]{40}")
_NEGATION = re.compile(r"\bnot (?:\w+ )?generated\b|\b(?:nothing|none) (?:in here |here )?is (?:copied|generated)\b|\b(?:written|edited|maintained|kept|made) by hand\b|\bedit freely\b|\breplaces? the generated\b|\b(?:at|on|during) (?:run ?time|import|start-?up|startup|load|first use)\b", re.I)
_LINE_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/?|//+[!/]?|#+!?|--+|;+|<!--)?[ \t]*")

_LONG_LINE = re.compile(r"[^\n]{120}")
_ENCODED = re.compile(r"[\"'`]([A-Za-z0-9+/=_\\-]{40,})[\"'`]")
_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[a-zA-Z]{0,3}\d{0,2}\s*,\s*){16,}")

#: Mined patterns stand on at least so many files with a sign, of so many projects. The lower bound (95 %, Wilson) of the
#: share of their files with a sign is above MINED_SHARE, or, for directories, that of files with a comment that says so is
#: above MINED_LIFT times the usual share: most of a copied tree carries no sign of its own.
MINED_SUPPORT, MINED_PROJECTS, MINED_SHARE, MINED_LIFT = 3, 3, 0.4, 1.5

_SLOT = re.compile(r"^[ \t]*(?:return[ \t]+)?[\w.$@]+(?:->[\w.]+)?\[\d+\];?[ \t]*$|\{[ \t]*return[ \t]+[\w.>-]+\[\d+\];?[ \t]*\}[ \t]*$", re.M)


def is_accessor_table(text: str) -> bool:
    """Whether a fifth of the lines or more, ten at least, do nothing but return a numbered slot."""
    slots = len(_SLOT.findall(text))
    return slots >= 10 and slots * 5 >= sum(1 for line in text.split("\n") if line.strip())


def _hinted(text: str) -> bool:
    low = one_form(text).lower()
    return any(h in low for h in _HINTS)


def comment_sign(text: str, language: str) -> bool:
    """Whether a comment of the text says that the file is generated or vendored."""
    if not _hinted(text):
        return False
    rx = LEXERS.get(language)
    comments = [m[0] for m in rx.finditer(text) if m.lastgroup == "c"] if rx else [text]
    for comment in comments:
        if not _hinted(comment):
            continue
        for line in one_form(comment).splitlines():
            line = _LINE_MARK.sub("", line)
            if _SIGN.search(line) and not _NEGATION.search(line):
                return True
    return False


def is_minified(text: str, language: str) -> bool:
    """Whether most of the code stands in long lines almost without blanks. Strings count as one sign each."""
    if not _LONG_LINE.search(text):
        return False
    code = Lexed(text, language).code if language in LEXERS else text
    dense = whole = 0
    for line in code.split("\n"):
        n = len(line)
        whole += n
        if n >= 120 and line.count(" ") + line.count("\t") < 0.1 * n and line.count(LITERAL) < 0.1 * n:
            dense += n
    return whole > 0 and dense >= 0.5 * whole


def is_bulk_data(text: str) -> bool:
    """Whether most of the text is encoded strings or long runs of numbers."""
    size = len(text.strip())
    if size < 400:
        return False
    data = 0
    if _LONG_WORD.search(text):
        data += sum(len(m[0]) + 6 for m in _ENCODED.finditer(text))
    if sum(map(text.count, _DIGITS)) >= 0.2 * size:
        data += sum(len(m[0]) for m in _NUMBERS.finditer(text))
    return data >= 0.5 * size


def text_sign(text: str, language: str) -> str | None:
    """The sign in the text itself: comment, minified, data, accessors or None."""
    if language in ("js", "ts", "css") and (_SOURCE_MAP.search(text) or _BANNER.search(text)):
        return "minified"
    if comment_sign(text, language):
        return "comment"
    if is_minified(text, language):
        return "minified"
    if is_bulk_data(text):
        return "data"
    if is_accessor_table(text):
        return "accessors"
    return None


def path_sign(path: str | None) -> bool:
    """Whether a path follows one of the conventions that hold everywhere."""
    return bool(path) and bool(_STANDARD.search(path.partition("/")[2] or path))


def glob_regex(pattern: str) -> str:
    """The regular expression of an attribute-file pattern, for a path relative to the file's directory."""
    anchored = "/" in pattern.rstrip("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def attribute_rules(path: str, text: str | None) -> list[dict]:
    """(dir, line, regex, on) of the lines of an attribute file that declare paths generated or vendored, or not; the
    expression is for paths relative to the file's directory."""
    directory = path.rpartition("/")[0]
    rules = []
    for n, line in enumerate((text or "").splitlines()):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        for attribute in words[1:]:
            name, _, value = attribute.lstrip("-!").partition("=")
            if name.rpartition("-")[2] in ("generated", "vendored"):
                on = attribute[0] not in "-!" and value.lower() in ("", "true", "set", "1")
                rules.append({"dir": directory, "line": n, "regex": f"^{glob_regex(words[0])}$", "on": on})
    return rules


ATTRIBUTE_FILE = ".gitattributes"
_RULE = pa.list_(pa.struct([("dir", pa.string()), ("line", pa.int32()), ("regex", pa.string()), ("on", pa.bool_())]))


def file_signs(documents: DataFrame, id_column: str = "doc_id", path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """(doc_id, file_path, sign, by_path, rules) of non-blank texts: one narrow pass, the text goes no further. ``rules``
    are those of an attribute file, null for other files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, signs, paths, rules = [], [], [], []
            for i, (path, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if text is None or not text.strip():
                    continue
                at.append(i)
                own = path is not None and path.rpartition("/")[2] == ATTRIBUTE_FILE
                rules.append(attribute_rules(path, text) if own else None)
                paths.append(path_sign(path))
                signs.append(text_sign(text, extension(path)))
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(signs, pa.string()), pa.array(paths, pa.bool_()), pa.array(rules, _RULE)], names=["doc_id", "file_path", "sign", "by_path", "rules"])

    source = documents.select(documents[id_column].cast("bigint").alias("doc_id"), documents[path_column].alias("file_path"), documents[text_column].alias("text"))
    return source.mapInArrow(run, "doc_id bigint, file_path string, sign string, by_path boolean, rules array<struct<dir:string,line:int,regex:string,on:boolean>>")


def declared_paths(signs: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_path, declared): what attribute files say of paths: deeper files first, in a file the last matching line."""
    return ruled(signs, rules, "file_path").withColumnRenamed("on", "declared")


def path_features(signs: DataFrame) -> DataFrame:
    """(file_path, project, feature, said, marked): the patterns a path may be known by, one row each.

    Directory names below the project; endings of the file name, its first part, and the name with what looks like a
    version or a hash taken out. ``said``: a comment says so; ``marked``: there is any sign in the text.
    """
    parts = F.split("file_path", "/")
    name = F.lower(F.element_at(parts, -1))
    directories = F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    ending = F.concat(F.lit("*"), F.regexp_extract(name, r"((?:[._-][a-z][a-z-]{0,15})+\.\w+)$", 1))
    first = F.regexp_replace(name, r"^([a-z]{2,9}[_.-]).*(\.\w+)$", "$1*$2")
    masked = F.regexp_replace(name, r"(?<=[._-])(?=[0-9a-z]*\d)[0-9a-z]{5,32}(?=[._-])", "#")
    hashed = F.regexp_replace(F.when(F.contains(masked, F.lit("#")), masked), "^[a-z0-9]*", "*")
    names = F.array(F.when(ending != "*", ending), F.when(first != name, first), F.when(~hashed.rlike(r"^\*_#\.\w+$"), hashed))
    features = F.concat(F.transform(directories, lambda x: F.concat(F.lower(x), F.lit("/"))), names)
    said, marked = F.coalesce(F.col("sign") == "comment", F.lit(False)), F.col("sign").isNotNull()
    rows = signs.where("file_path is not null").select("file_path", parts[0].alias("project"), said.alias("said"), marked.alias("marked"), F.explode(F.array_distinct(features)).alias("feature"))
    return rows.where("feature is not null")


def _lower_bound(k: Column, n: Column, z: float = 1.64) -> Column:
    """The lower end of the Wilson interval of the share k / n."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mined_patterns(signs: DataFrame) -> DataFrame:
    """(feature): path patterns of files with a sign. Counts cover all files; partial sums before the shuffle."""
    usual = signs.agg(F.avg(F.coalesce(F.col("sign") == "comment", F.lit(False)).cast("double")).alias("share")).first()["share"] or 0.0
    counts = path_features(signs).groupBy("feature", "project").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("said").cast("long")).alias("said"), F.sum(F.col("marked").cast("long")).alias("k"))
    by_feature = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("said").alias("said"), F.sum("k").alias("k"), F.sum((F.col("k") > 0).cast("long")).alias("projects"))
    often = (F.col("k") >= MINED_SUPPORT) & (F.col("projects") >= MINED_PROJECTS)
    lifted = F.endswith("feature", F.lit("/")) & (F.col("said") > 0) & (_lower_bound(F.col("said"), F.col("n")) > MINED_LIFT * usual)
    return by_feature.where(often & ((_lower_bound(F.col("k"), F.col("n")) > MINED_SHARE) | lifted)).select("feature")


def not_handwritten(documents: DataFrame, attribute_files: DataFrame | None = None) -> DataFrame:
    """(doc_id, reason) of the files nobody wrote by hand for their project; the first of these that holds: declared,
    mined, path, then the sign in the text.

    ``attribute_files`` has file_path and text of attribute files; by default they are those among the documents.
    """
    signs = written(file_signs(documents), "signs")
    mined = path_features(signs).join(mined_patterns(signs), "feature", "left_semi").select("file_path").distinct().withColumn("mined", F.lit(True))
    found = signs.join(mined, "file_path", "left")
    held = signs if attribute_files is None else file_signs(attribute_files.withColumn("doc_id", F.lit(0)))
    rules = held.where("rules is not null").select(F.inline("rules"))
    if attribute_files is None and rules.isEmpty():
        found = found.withColumn("declared", F.lit(None).cast("boolean"))
    else:
        found = found.join(declared_paths(signs, rules), "file_path", "left")
    reason = F.when(F.col("declared"), "declared").when(F.col("mined"), "mined").when(F.col("by_path"), "path").otherwise(F.col("sign"))
    judged = found.where(F.coalesce(F.col("declared"), F.lit(True)))
    return judged.select("doc_id", reason.alias("reason")).where("reason is not null")
