import ast
import json
import unicodedata

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import corpus_encoding as ce
from sondage.llm import documented_functions as df_
from sondage.llm import handwritten as hw
from sondage.llm import parse_faults as pf
from sondage.llm import visual_form as vf

PATH = f"{ce.TOKENIZERS}/{ce.NAME}.tiktoken"

SOUND = {
    "py": "def f(a: int = 3):\n    '''it's'''\n    return {'a': [1, (2)]}\n",
    "rs": "#[inline]\nfn f<'a>(x: &'a str) -> u8 {\n    let c = '{';\n    let s = r#\"a\"b\"#;\n    x.len() as u8\n}\n",
    "js": "const re = /[({]+/g;\nconst t = `a ${b} \"`;\nfunction f(a) {\n  for (const x of a) { g(x) }\n  return a / 2 / 3;\n}\n",
    "ts": "interface A {\n  b?: string;\n}\nexport function f(a: string[]): number {\n  return a.length;\n}\n",
    "go": "package a\n\nimport \"fmt\"\n\ntype T struct {\n\tName string\n}\n\nfunc (t *T) F(a, b int) (int, error) {\n\tr := '{'\n\ts := `x\ny`\n\treturn a, nil\n}\n",
    "java": "package a.b;\n\npublic class A {\n    @Override\n    public int f(List<String> x) throws E {\n        char c = '{';\n        for (String s : x) {\n            g(s);\n        }\n        return 1;\n    }\n}\n",
    "c": "#include <a.h>\n#ifdef X\nint y;\n#endif\nstatic int f(const char *s) {\n    if (!s) {\n        goto out;\n    }\nout:\n    return '{';\n}\n",
    "cpp": "#include <vector>\nnamespace a {\nclass B : public C {\n public:\n  int f() const { return 1'000; }\n};\n}\nauto s = R\"x(a\")x\";\n",
    "rb": "# it's\nclass A\n  def f(x)\n    return 1 unless x\n    y = x.map { |v| v + 1 }\n    x.each do |v|\n      puts v\n    end\n    while y < 3\n      y += 1\n    end\n  end\nend\n",
    "json": '{"a": [1, 2, {"b": null}]}\n',
    "toml": "[a]\nb = [1, 2]\nc = \"x\" # it's\n",
    "css": "/* it's */\n.a > b { color: #fff; }\n@media (max-width: 3px) { .c { margin: 0 } }\n",
}


@pytest.mark.parametrize("language", list(SOUND))
def test_sound_and_broken(language):
    text = SOUND[language]
    assert pf.fault(text, language) is None
    assert pf.fault(text.replace("\n", "\r\n"), language) is None
    assert pf.fault(text.rstrip("\n"), language) is None
    assert pf.fault("\ufeff" + text, language) is None
    if language not in ("json", "toml", "css"):
        end = text.rindex("\n", 0, len(text) - 1) + 1
        assert pf.fault(text[:end] + "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n" + text[end:], language)
        assert pf.fault(text[:end] + "@@ -1,2 +3,4 @@\n" + text[end:], language)
    if language in ("json", "toml", "rb", "py", "ts"):
        for i, ch in enumerate(text):
            if ch in "}])":
                assert pf.fault(text[:i] + text[i + 1 :], language), i


@pytest.mark.parametrize("own", [k for k in SOUND if k not in ("css", "json", "toml")])
def test_wrong_extension(own):
    for other in SOUND:
        if own == other or (own, other) in (("js", "ts"), ("c", "cpp")) or other in ("css", "json", "toml"):
            continue
        assert pf.fault(SOUND[own], other), (own, other)


@pytest.mark.parametrize(
    "language, text, wrong",
    [
        ("c", "#define F(x) {\nint a;\n", None), ("c", "#ifdef A\nif (x) {\n#else\nif (y) {\n#endif\n}\n", None), ("c", "#if 0\n}\n#endif\nint a;\n", None), ("c", "#ifdef A\nint a;\n", "unbalanced directive"), ("c", "int f(int a) { return (a + ) ; }\n", "missing operand"),
        ("js", "if (x) /'/.test(y);\n", None), ("js", "const x = 1 +;\n", "missing operand"), ("js", "l: for (;;) { i++; --j; x = a / b / c; }\n", None), ("rs", "fn f() { let x = ; }\n", "missing operand"), ("rs", "fn f<T: A + 'static>(x: &mut T) -> Vec<u8> { x.iter().map(|v| v + 1).collect::<Vec<_>>() }\n", None),
        ("css", "a { color: ; }\n", "missing operand"), ("css", "a { --x: ; color: red; }\n", None), ("cpp", "struct A { bool operator==(const A&) const; A& operator=(const A&) = default; };\nauto f = [=](int x) { return x; };\n", None),
        ("java", "class A { List<? extends B> x = a >= b ? c : d; int[] y = {1, 2,}; }\n", None), ("go", "package a\n\nfunc f(a ...int) (x chan<- int) { x = make(chan int, 3); return }\n", None), ("ts", "const a = <T,>(x: T): T => x;\nfunction f(a?: number, ...b: string[]) { return a! + 1; }\nlet [, b = 2] = c;\n", None),
        ("json", '{"a": [1, 2,]}', "missing operand"), ("json", '{"a" 1}', "missing operator"), ("json", "[1, 2] 3", "missing operator"), ("json", '{"a": 29; "b": 1}', "missing operator"), ("py", "def f():\n", "premature end"), ("py", "if x:\n    a\n  b\n", "uneven indent"), ("py", "a = 1\n  b = 2\n", "unexpected indent"), ("py", "def f():\nx = 1\n", "block without body"), ("py", "x = y z\n", "missing operator"),
    ],
)
def test_states(language, text, wrong):
    assert pf.fault(text, language) == wrong


def test_fault_of_nothing():
    assert pf.fault(None, "py") is None and pf.fault("  \n", "py") is None and pf.fault("x (", "txt") is None
    assert pf.fault("x = 'a" + "b" * 200_000, "py") == "unterminated literal"


@pytest.mark.parametrize("text", ['{"a": NaN}', "[Infinity]", "[-Infinity, 1]", "NaN"])
def test_json_constants(text):
    assert pf.fault(text, "json")
    assert pf.fault(json.dumps([text]), "json") is None


@pytest.mark.parametrize(
    "language, start, sound, broken, end",
    [
        ("json", "[" * 200_000, "1", "1 2", "]" * 200_000),
        ("json", '[{"x]": ' * 60_000, "{}", "{,}", "}]" * 60_000),
        ("toml", "[[a]]\nb = " + "[" * 60_000, "1, # ]\n'['", "1 2", "]" * 60_000),
        ("toml", "a = " + "[{b = " * 20_000, "1", "x", "}]" * 20_000),
        ("py", "x = " + "(" * 199, "1", "1 2", ")" * 199),
        ("py", "x = " + "(lambda x=" * 199, "f(a, *b)", "f(a b)", ": 0)" * 199),
        ("py", "x = " + "-" * 50_000, "1", "", "\n"),
        ("py", "x = " + "1 + " * 50_000, "1", "* 1", "\n"),
    ],
)
def test_deep_texts(language, start, sound, broken, end):
    assert pf.fault(start + sound + end, language) is None
    assert pf.fault(start + broken + end, language)


def test_fault_rows(spark):
    docs = spark.createDataFrame([(1, "a/x.py", "x = (", "p"), (1, "a/x.py", "x = (", "p"), (2, "a/y.py", "x = 1\n", "p"), (3, None, "x", "p"), (4, "a/z.js", None, "p"), (5, "a/w.js", " ", "q")], "doc_id bigint, file_path string, text string, project string")
    assert sorted((r.doc_id, r.fault) for r in pf.parse_faults(docs).collect() if r.fault) == [(1, "premature end")] * 2
    assert [tuple(r) for r in pf.fault_rates(pf.parse_faults(docs, ("project",))).collect()] == [("p", "python", 3, 2, 0.666667)]
    assert pf.parse_faults(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_encoding_round_trip(text):
    ids = ce.encode_text(text, PATH)
    assert ce.decode_ids(ids, PATH) == text
    assert ids.tolist() == ce.tokenizer(PATH).encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\tcé表の。、1٣.'’s\u0301\u00a0\x1c", max_size=400), st.integers(1, 40))
def test_safe_parts(text, long):
    parts = list(ce.safe_parts(text, long))
    assert "".join(parts) == text
    assert [i for p in parts for i in ce.encode_text(p, PATH).tolist()] == ce.encode_text(text, PATH).tolist()


def test_long_texts_of_any_script_are_cut():
    for text in ("検索の索引を読み込む。" * 20_000, "a,b;" * 60_000, "слово" * 30 + "—" + "a1" * 100_000):
        parts = list(ce.safe_parts(text, 1000))
        assert "".join(parts) == text and (len(parts) > 50 or "a1" in text)


def test_encoding_against_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{ce.TOKENIZERS}/{ce.NAME}.json")
    t.encode_special_tokens = True
    for text in ["a  b\n\n  c", "<|endoftext|> x", "naïve 表 \u200d", "x" * 3000, " " * 50 + "y", "it's we'll 12345"]:
        assert ce.encode_text(text, PATH).tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoding_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "", 7), (3, None, 7), (1, "a b", 7)], "doc_id bigint, text string, ids int")
    assert sorted((r.doc_id, list(r.ids)) for r in ce.encode_corpus(docs).collect()) == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in ce.count_tokens(docs, ["doc_id"]).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert ce.encode_corpus(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "one, other",
    [("ｆｏｏ１", "foo1"), ("cafe\u0301", "caf\u00e9"), ("a\u200bb\u2060c\ufeff\u00ad", "abc"), ("a\u00a0b\u3000c\u2009", "a b c "), ("сору", "copy"), ("Ηello", "Hello"), ("е\u0301", "\u00e9"), ("x\u200dy", "xy")],
)
def test_same_look(one, other):
    assert vf.one_form(one) == vf.one_form(other)


@pytest.mark.parametrize("one, other", [("x²", "x2"), ("a", "A"), ("e", "é"), ("l", "1"), ("\U0001f469\u200d\U0001f527", "\U0001f469\U0001f527"), ("a b", "a  b"), ("ß", "ss"), ("µ", "u")])
def test_other_look(one, other):
    assert vf.one_form(one) != vf.one_form(other)


def _plain_form(text):
    """Both steps over whole texts, without segments."""
    for table in (vf._FOLDS, {ord(k): v for k, v in vf.LOOKALIKES.items()}):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))
    return text


def test_genuine_words_stay():
    russian = "Москва, сосна и ёлка — «пример».\n"
    assert vf.normal_form(russian) == vf.consistent_form(russian) == russian
    assert vf.consistent_form("p\u0430ypal ｆｏｏ caf\u0065\u0301 a\u200bb\u00a0c \U0001d400\ufb01\u2028x") == "paypal foo caf\u00e9 ab c Afi\nx"
    assert vf.one_form("\ua4d0\u04c0\ufe63") == "Bl-" and vf.one_form("µ") == vf.one_form("μ")
    assert vf.consistent_form("⁵ x² ① ½") == "⁵ x² ① ½"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z1\n\u0301\u0308\u00e9\u00a0\u200b\ufeffоеＡｂß表한\u1100\u1161\u3000²"), max_size=40))
def test_segments_equal_whole(text):
    assert vf.one_form(text) == _plain_form(text)
    assert vf.one_form(vf.one_form(text)) == vf.one_form(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \u0301\u0308\u0451\u0401\u0435\u0415\u0457\u0456\u03cc\u03bf\u00eb\u00f3\u0439\u200b"), max_size=40))
def test_accented_look_alikes(text):
    assert vf.one_form(text) == _plain_form(text)
    assert {vf.one_form(unicodedata.normalize(form, text)) for form in ("NFC", "NFD")} == {vf.one_form(text)}


@pytest.mark.parametrize("word", ["лёд", "идёт", "днём", "ёлки", "її", "τό", "Ё"])
def test_composed_and_decomposed_pair(spark, word):
    twin = unicodedata.normalize("NFD", word)
    assert vf.one_form(word) == vf.one_form(twin)
    keys = vf.form_keys(spark.createDataFrame([(1, word + " x"), (2, twin + " x")], "doc_id bigint, text string"))
    assert [tuple(r) for r in vf.same_look_pairs(keys).collect()] == [(1, 2)]


def test_same_look_pairs(spark):
    rows = [(1, "abc x"), (2, "аbc x"), (3, "abc x"), (4, "ABC x"), (5, None), (6, " "), (7, "abc\u00a0x"), (1, "abc x"), (None, "abc x")]
    keys = vf.form_keys(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((r.doc_id_a, r.doc_id_b) for r in vf.same_look_pairs(keys).collect())
    assert got == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7)]
    assert vf.same_look_pairs(keys.limit(0)).count() == 0


GOOD = "Given a frozen hatch, scores its pallet using at most one planner."


@pytest.mark.parametrize("text", [GOOD, "// " + GOOD, "/**\n * " + GOOD + "\n * @param x the thing\n */", "Lê cada índice e mantém só os três com maior pontuação.", "キューの要素を順番に読み込み、古い値を捨ててから次の段階に渡します", "Region and counter are written together and logs a warning.", "Insert the new row into the queue once it is checked."])
def test_meaningful(text):
    assert df_.meaningful(text, "other_name")


@pytest.mark.parametrize("text", [None, "", "...", "TODO(x): write something here that is really long enough", "à compléter", "// eslint-disable-next-line no-unused-vars one two three four", "@param a the first of all the many things\n@returns the sum of all of it", "Copyright (c) 2004 the tally authors. All rights reserved. Use is subject to terms.", "int a_b = f_g(h_i, 28);\nlong c_d = f_g(h_i, 28);\nlong e_f = f_g(h_i, 2);", "=============== ledger ===============", "The sweep cached tariff function.", "with f(x) as handle:     handle.write(y)\nreturn x"])
def test_not_meaningful(text):
    assert not df_.meaningful(text, "sweep_cached_tariff")


def test_docstring():
    assert df_.docstring("def f(a: dict = {'x': 1}, *, b='):'):\n    # note\n    r'''A doc.'''\n    pass") == "A doc."
    assert df_.docstring("async def f(\n  a,\n) -> int: 'x'") == "x"
    assert df_.docstring("def f():\n    x = 'a'") is None
    assert df_.docstring("def f():\n    f'x'") is None
    assert df_.docstring(None) is None and df_.docstring("class A:\n  'x'") is None


RS = f"// {GOOD}\n#[inline]\nfn a() {{\n}}\n\n// {GOOD}\n\nfn b() {{\n    // {GOOD}\n    let s = \"// no\";\n}}\n/* {GOOD} */\nfn c() {{ x(); }}\nlet y = 1; // {GOOD}\nfn d() {{}}\n"


def test_documented_functions(spark):
    stored = "stored words that would be quite enough to count here"
    chunks = [(n, "p/a.rs", "rust", "function", name, None, stored, "", at) for n, (name, at) in enumerate([("a", 2), ("b", 7), ("c", 12), ("d", 14)])]
    chunks += [chunks[0], (9, "gone.rs", "rust", "method", "e", None, GOOD, "fn e() {}", 3), (10, "p/a.rs", "rust", "struct", "a", None, GOOD, "x", 2), (11, None, None, "function", None, None, None, None, None)]
    chunks += [(12, "p/b.py", "python", "function", "g", None, None, f'def g():\n    """{GOOD}"""\n', 0)]
    c = spark.createDataFrame(chunks, "id bigint, file_path string, language string, kind string, name string, signature string, doc_comment string, body string, line_start int")
    docs = spark.createDataFrame([("p/a.rs", RS, 1), ("p/b.py", f'def g():\n    """{GOOD}"""\n', 2), ("p/c.py", None, 3), (None, "x", 4)], "file_path string, text string, line int")
    assert sorted(r.id for r in df_.documented_functions(c, docs).collect()) == [0, 2, 9, 12]
    assert df_.documented_functions(c.limit(0), docs).count() == 0
    assert sorted(r.id for r in df_.documented_functions(c, docs.limit(0)).collect()) == [0, 1, 2, 3, 9, 12]
    found = sorted((r.name, r.line_start, r.line_end) for r in df_.delimited_functions(docs).collect())
    assert found == [("a", 2, 4), ("b", 7, 11), ("c", 12, 13), ("d", 14, 15), ("g", 0, 2)]
    twice = sorted((r.name, r.line_start, r.line_end) for r in df_.delimited_functions(docs.union(docs)).collect())
    assert twice == sorted(found * 2)


PY = '''import os

class A:
    @property
    def a(self): return 1

    async def b(
        self, x=(
    1),
    ):
        """Text
def no(): pass
"""
        if x:
            def inner():
                return [
    1,
]
    # a comment
        # and another

    def c(self): return (1,
        2)
def d():
    x = """
 end""" + \\
  "y"  # def e():

if os:
\tdef f():
\t\tpass
'''
PY_FUNCTIONS = [(n.name, n.lineno - 1, n.end_lineno) for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]

RB = '''module M
  class << self
    def a=(v)
      @v = v if v
      return unless v
      while v do
        v = if v then 1 else 2 end
      end
      v.class; v&.end
    end; def b; end
  end
  def self.c?(x, y = f(g(1))) = x.map { |v| v + 1 }
  def d(x) =
    x.any? do |v|
      v
    end

  private def e(k = "end", end: 1)
    s = <<~SQL.lines do |l|
      def no
      end
    SQL
      l
    end
    %w[if do].each { |w| puts w unless w }
    begin
      x = case k when 1 then :end else { if: 1 } end
    end until x
    yield(1) if x.begin?
    # end
  end
  def ==(o) = o
  def [](i)
    x.valid? if i
    for j in i do j end
    loop do break if j end
  end
end
'''
RB_FUNCTIONS = [("a=", 2, 10), ("b", 9, 10), ("c?", 11, 12), ("d", 12, 16), ("e", 17, 31), ("==", 31, 32), ("[]", 32, 37)]


def test_delimited_functions_by_indent_and_by_end(spark):
    texts = {"p/a.py": PY, "p/b.py": PY.replace("\n", "\r\n"), "p/c.py": PY.rstrip("\n"), "p/a.rb": RB, "p/b.rb": RB.replace("\n", "\r\n"), "p/a.rs": RS, "p/e.py": "", "p/f.rb": None}
    docs = spark.createDataFrame(list(texts.items()), "file_path string, text string")
    found = {}
    for r in df_.delimited_functions(docs).collect():
        found.setdefault(r.file_path, []).append((r.name, r.line_start, r.line_end))
    assert {k: sorted(v, key=lambda x: x[1:]) for k, v in found.items()} == {
        **{f"p/{k}.py": sorted(PY_FUNCTIONS, key=lambda x: x[1:]) for k in "abc"},
        **{f"p/{k}.rb": sorted(RB_FUNCTIONS, key=lambda x: x[1:]) for k in "ab"},
        "p/a.rs": [("a", 2, 4), ("b", 7, 11), ("c", 12, 13), ("d", 14, 15)],
    }


def test_functions_query_holds_all_languages(spark, sf_dir):
    from sondage.llm.queries import QUERIES

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").where("kind in ('function', 'method')")
    missing = chunks.select("file_path", "line_start", "line_end").distinct().join(QUERIES["p6_functions"](spark, sf_dir), ["file_path", "line_start", "line_end"], "left_anti")
    assert chunks.count() > 0 and missing.count() == 0


@pytest.mark.parametrize("line", ["// Code generated by x-gen. DO NOT EDIT.", "# Fichier produit automatiquement par x-gen; ne pas modifier.", "// Automatisch erzeugt aus matrix.def - nicht bearbeiten.", "/* @generated by x */", "// <auto-generated> x 1.2 </auto-generated>", "// Vendored from drunta 1.2.3; local changes: none.", "// Generated from a.schema at build time; do not modify by hand.", "// Code g\u0435nerated by x-gen. DO NOT EDIT.", "# This module was produced by our schema compiler; edits are overwritten.", "# Vendored: left-pad 1.2"])
def test_comment_signs(line):
    assert hw.comment_sign(line + "\nx = 1\n", "py" if line[0] == "#" else "js")
    assert not hw.comment_sign("x = " + json.dumps(line) + "\n", "js")


@pytest.mark.parametrize("line", ["This replaces the generated client, please edit freely.", "Values in this table are generated by the planner at run time, see the notes.", "Turns generated tables into pages.", "Written by hand; the report itself is generated elsewhere.", "Reads vendored packages and lists them, nothing in here is copied.", "The code is generated by the parser at import"])
def test_no_comment_signs(line):
    assert not hw.comment_sign(f"// {line}\nx = 1\n", "js")


def test_text_signs():
    assert hw.is_minified("var a=function(b){for(var i=0;i<3;i++)b.c(i);return b};" * 9, "js")
    assert not hw.is_minified('const p = "' + "some words here " * 60 + '";\n', "js")
    assert hw.is_bulk_data("x = (\n" + '    "' + "\"\n    \"".join(["9f" * 36] * 12) + '"\n)\n')
    assert hw.is_bulk_data("var x = []int{\n" + "\t1, 2, 3, 4, 5, 6, 7, 8,\n" * 40 + "}\n")
    assert not hw.is_bulk_data("const L = [1, 2, 3];\n" + "function f() { return L; }\n" * 40)


def test_path_signs():
    for path in ["p/vendor/a/x.go", "p/x.min.js", "p/a/package-lock.json", "p/src/x_pb2.py", "p/src/x.pb.go", "p/node_modules/a/b.js", "p/3rdparty/x.c"]:
        assert hw.path_sign(path), path
    for path in ["p/app/models/vendor_invoice.py", "p/tools/codegen/writer.rs", "p/src/generated_columns.py", "vendor/src/a.py", "p/build-tools/a.js", "p/src/external/api.py", "p/lib/gen/handler.go", "p/deps/x.py", None]:
        assert not hw.path_sign(path), path


def test_attribute_files(spark):
    """Nested attribute files: the deeper one first, in a file the last matching line."""
    files = {"p/.gitattributes": "# x\n*.gen.py linguist-generated\nlib/** linguist-vendored=true\nlib/own/* -linguist-vendored\n/top.c linguist-generated\nx text\n", "p/deep/.gitattributes": "*.gen.py -linguist-generated\n", "q/.gitattributes": "*.py linguist-generated\n"}
    want = {"p/a.gen.py": True, "p/q/a.gen.py": True, "p/deep/a.gen.py": False, "p/deep/er/a.gen.py": False, "p/lib/a/b.c": True, "p/lib/own/c.c": False, "p/top.c": True, "p/q/top.c": None, "p/z.py": None, "q/z.py": True}
    rows = [(i, path, "let x = 1\n") for i, path in enumerate(want)] + [(100 + i, path, text) for i, (path, text) in enumerate(files.items())] + [(200, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, file_path string, text string")
    signs = hw.file_signs(docs)
    got = {r.file_path: r.declared for r in hw.declared_paths(signs, signs.where("rules is not null").select(F.inline("rules"))).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}
    reasons = {r.doc_id: r.reason for r in hw.not_handwritten(docs).collect()}
    assert reasons == {i: "declared" for i, path in enumerate(want) if want[path]}


def test_mined_patterns_hold_for_other_projects(spark):
    """Patterns mined in some projects mark the files of a project where no file says so."""
    mark = "// Vendored from drunta 1.2.3; local changes: none.\nlet x = 1;\n"
    rows = [(i, f"p{i % 9}/src/f{i}.js", "let y = 1;\n") for i in range(300)]
    rows += [(1000 + i, f"p{i % 9}/libs/imported/f{i}.js", mark if i % 2 == 0 and i % 9 else "let y = 1;\n") for i in range(90)]
    rows += [(2000 + i, f"held/{d}/f{i}.js", "let y = 1;\n") for i, d in enumerate(["imported", "src", "imported/deep", "other"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, file_path string, text string")
    reasons = {r.doc_id: r.reason for r in hw.not_handwritten(docs).collect()}
    assert {i: r for i, r in reasons.items() if i >= 2000} == {2000: "mined", 2002: "mined"}
    assert all(reasons.get(1000 + i) == "mined" for i in range(90)) and not any(i < 300 for i in reasons)


def test_not_handwritten(spark):
    mark = "// Code generated by x-gen. DO NOT EDIT.\nlet x = 1;\n"
    rows = [(1, "p/a.js", mark), (2, "p/b.js", "let y = 1;\n"), (3, "p/vendor/c.js", "let z = 1;\n"), (4, "p/vendor/own.js", mark), (5, None, mark), (6, "p/d.js", None), (7, "p/e.js", "  "), (2, "p/b.js", "let y = 1;\n")]
    rows += [(100 + i, f"q{i % 4}/oddgen/f{i}.js", mark if i < 8 else "let y = 1;\n") for i in range(12)] + [(200 + i, f"q{i % 4}/src/g{i}.js", "let y = 1;\n") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, file_path string, text string")
    attributes = spark.createDataFrame([("p/.gitattributes", "vendor/own.js -linguist-vendored\nb.js linguist-generated\n")], "file_path string, text string")
    plain = {r.doc_id for r in hw.not_handwritten(docs).collect()}
    assert plain == {1, 3, 4, 5} | {100 + i for i in range(12)}
    ruled = {r.doc_id for r in hw.not_handwritten(docs, attributes).collect()}
    assert ruled == plain - {4} | {2}
    assert hw.not_handwritten(docs.limit(0)).count() == 0
