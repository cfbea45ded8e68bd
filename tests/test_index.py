import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sondage.config import Config, load
from sondage.errors import IndexNotFound
from sondage.operators import chunking, incremental, summary
from sondage.operators.embedding import DummyEmbedder
from sondage.plans.index import build_index, index_status
from sondage.plans.search import search
from sondage.sources.index_store import IndexStore, project_dir
from sondage.sources.scan import scan, skipped
from sondage.storage import shared_dir
from sondage.streaming import watch

PY = "class Box:\n    \"\"\"A box.\"\"\"\n\n    def open(self, key: str) -> bool:\n        return key == self.key\n\n\ndef close_box(box):\n    box.shut = True\n"
RS = "/// Opens a gate.\npub fn open_gate(x: u64) -> bool {\n    x > 1\n}\n\npub struct Gate {\n    pub n: u64,\n}\n\nimpl Gate {\n    fn shut(&self) {\n        drop(self.n);\n    }\n}\n"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src" / "box.py").write_text(PY)
    (root / "src" / "gate.rs").write_text(RS)
    (root / "src" / "x.min.js").write_text("var a=1\n")
    (root / "skip.log").write_text("x")
    (root / ".hidden.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("*.log\nout/\n")
    return root


def test_chunks_of_texts():
    py = chunking.chunk_text("box.py", PY, "python")
    assert [(c["kind"], c["name"]) for c in py] == [("class", "Box"), ("function", "open"), ("function", "close_box")]
    rs = chunking.chunk_text("gate.rs", RS, "rust")
    assert [(c["kind"], c["name"], c["line_start"], c["line_end"]) for c in rs] == [("function", "open_gate", 1, 4), ("struct", "Gate", 5, 8), ("module", None, 9, 14), ("function", "shut", 10, 13)]
    assert rs[0]["doc_comment"] == "Opens a gate." and rs[0]["signature"] == "pub fn open_gate(x: u64) -> bool"
    for c in py + rs:
        text = PY if c in py else RS
        assert text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["body"]
    long = "".join(f"x{i}\n" for i in range(120))
    blocks = chunking.chunk_text("a.rs", long, "rust")
    assert [(b["name"], b["line_start"], b["line_end"]) for b in blocks] == [("a.rs:L1-L50", 0, 50), ("a.rs:L51-L100", 50, 100), ("a.rs:L101-L120", 100, 120)]
    assert chunking.chunk_text("a.json", "{\n}\n", "json")[0]["kind"] == "block"
    assert chunking.chunk_text("a.json", "1\n" * 101, "json") == []
    assert chunking.chunk_text("a.py", "", "python") == []


def test_summary(spark):
    rows = [("function", "f", "python", "def f():", "  d" * 300, "# c\n\ndef f():\n{\n    return 1\n"), ("block", None, "rust", " ", None, "")]
    df = spark.createDataFrame(rows, "kind string, name string, language string, signature string, doc_comment string, body string")
    a, b = (r.s for r in df.select(summary.summary(df).alias("s")).collect())
    lines = a.split("\n")
    assert lines[:3] == ["function f", "language: python", "signature: def f():"] and lines[3].endswith("...") and len(lines[3]) == 503
    assert lines[4:] == ["def f():", "    return 1"] and b == "language: rust"


def test_scan_rules(spark, tree):
    found = {r.relative for r in scan(spark, str(tree)).select("relative").collect()}
    assert found == {"src/box.py", "src/gate.rs"}
    for name in ("src/__init__.py", "src/deep/a.log", "src/deep/keep.log", "src/deep/out/x.py", "src/deep/b.tmp", "own/c.tmp", "own/d.bak", "empty.py"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("" if name == "empty.py" else "x = 1\n")
    (tree / "src" / "deep" / ".gitignore").write_text("!keep.log\n*.tmp\n")
    (tree / ".git" / "info").mkdir(parents=True)
    (tree / ".git" / "info" / "exclude").write_text("*.bak\n")
    (tree / "link.py").symlink_to(tree / "src" / "box.py")
    more = {r.relative for r in scan(spark, str(tree), ignore_text="empty.*\n").select("relative").collect()}
    assert more == found | {"src/__init__.py", "src/deep/keep.log", "own/c.tmp"}
    assert skipped(spark, str(tree)) == 0 and scan(spark, str(tree / "src" / "none")).count() == 0 if (tree / "src" / "none").mkdir() is None else False


def test_build_update_search(spark, tree, tmp_path):
    index = project_dir(str(tmp_path / "idx"), str(tree))
    e = DummyEmbedder(8)
    with pytest.raises(IndexNotFound):
        search(spark, index, "x")
    assert index_status(spark, index)["exists"] is False
    first = build_index(spark, str(tree), index, embedder=e)
    assert (first["changed"], first["deleted"]) == (2, 0)
    assert build_index(spark, str(tree), index, embedder=e)["unchanged"] == 2
    rows = search(spark, index, "open", "text").collect()
    assert {r.name for r in rows} >= {"open", "open_gate"}
    assert search(spark, index, "fn open*(*) -> bool", "ast").first().name in ("open", "open_gate")
    (tree / "src" / "new.go").write_text("package a\n\nfunc Walk(n int) int {\n\treturn n\n}\n")
    (tree / "src" / "gate.rs").write_text(RS.replace("open_gate", "lift_gate"))
    os.utime(tree / "src" / "gate.rs", (time.time() + 9, time.time() + 9))
    (tree / "src" / "box.py").unlink()
    second = build_index(spark, str(tree), index, embedder=e)
    assert (second["changed"], second["deleted"], second["unchanged"]) == (2, 1, 0)
    full = project_dir(str(tmp_path / "full"), str(tree))
    build_index(spark, str(tree), full, embedder=e, force=True)
    for name in ("chunks", "vectors", "postings"):
        one, other = (IndexStore(spark, p).read(name) for p in (index, full))
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert index_status(spark, index)["version"] == 2


def _files(index):
    return {str(p.relative_to(index)) for p in index.rglob("*.parquet")}


def test_one_changed_file_is_one_small_segment(spark, tree, tmp_path):
    """A change writes its own rows: the files of the segments before stay as they are, and a touched file only its time."""
    index, e = tmp_path / "inc", DummyEmbedder(8)
    for i in range(6):
        (tree / "src" / f"m{i}.py").write_text(PY.replace("Box", f"Box{i}"))
    build_index(spark, str(tree), str(index), embedder=e)
    before = {p: (index / p).stat().st_mtime_ns for p in _files(index)}
    (tree / "src" / "m3.py").write_text(PY.replace("Box", "Crate"))
    os.utime(tree / "src" / "m3.py", (time.time() + 9, time.time() + 9))
    os.utime(tree / "src" / "m4.py", (time.time() + 9, time.time() + 9))
    counts = build_index(spark, str(tree), str(index), embedder=e)
    assert (counts["changed"], counts["deleted"], counts["unchanged"]) == (1, 0, 7)
    assert {p: (index / p).stat().st_mtime_ns for p in before} == before
    new = spark.read.parquet(str(index / "segments" / "2" / "chunks"))
    assert {r.file_path.rpartition("/")[2] for r in new.collect()} == {"m3.py"} and new.count() == 3
    store = IndexStore(spark, str(index))
    left = [p.name for p in Path(shared_dir(spark)).iterdir() if p.name.startswith(("listing", "stale", "chunks"))]
    build_index(spark, str(tree), str(index), embedder=e)
    assert sorted(left) == sorted(p.name for p in Path(shared_dir(spark)).iterdir() if p.name.startswith(("listing", "stale", "chunks")))
    assert store.manifest()["segments"] == [1, 2] and counts["chunks"] == store.read("chunks").count()
    assert store.meta().first().files == store.read("file_state").count() == 8
    names = {r.name for r in store.read("chunks").collect()}
    assert "Crate" in names and "Box3" not in names and "Box4" in names
    assert build_index(spark, str(tree), str(index), embedder=e)["unchanged"] == 8 and store.current() == 2


def test_segments_are_put_together(spark, tree, tmp_path, monkeypatch):
    from sondage.sources import index_store

    monkeypatch.setattr(index_store, "SEGMENTS", 2)
    index, e = str(tmp_path / "many"), DummyEmbedder(8)
    for i in range(3):
        (tree / "src" / "box.py").write_text(PY.replace("Box", f"Box{i}"))
        os.utime(tree / "src" / "box.py", (time.time() + 9 * i, time.time() + 9 * i))
        build_index(spark, str(tree), index, embedder=e)
    store = IndexStore(spark, index)
    assert len(store.manifest()["segments"]) == 1
    assert {"Box2", "open_gate"} <= {r.name for r in store.read("chunks").collect()} and "Box1" not in {r.name for r in store.read("chunks").collect()}
    assert store.read("cells").count() == store.read("vectors").count() == store.read("chunks").count()


def test_a_writer_that_dies_leaves_the_version_before(spark, tree, tmp_path, monkeypatch):
    index, e = str(tmp_path / "dies"), DummyEmbedder(8)
    build_index(spark, str(tree), index, embedder=e)
    (tree / "src" / "gate.rs").unlink()

    def dies(self, n):
        raise KeyboardInterrupt

    for step in ("_name", "_publish", "_write_cells"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(IndexStore, step, lambda self, *_: dies(self, 0))
            build_index(spark, str(tree), index, embedder=e)
        store = IndexStore(spark, index)
        assert store.current() == 1 and store.read("file_state").count() == 2 and "open_gate" in {r.name for r in store.read("chunks").collect()}
    assert build_index(spark, str(tree), index, embedder=e)["deleted"] == 1
    assert IndexStore(spark, index).read("file_state").count() == 1


def test_no_silent_stand_in(spark, tree, tmp_path):
    from sondage.errors import EmbedderError
    from sondage.operators.embedding import embedder_of

    for model in ("", str(tmp_path)):
        with pytest.raises(EmbedderError):
            build_index(spark, str(tree), str(tmp_path / "none"), Config(model=model))
    assert not IndexStore(spark, str(tmp_path / "none")).exists() and embedder_of("dummy").dimension == 384
    build_index(spark, str(tree), str(tmp_path / "some"), Config(model="dummy"))
    assert IndexStore(spark, str(tmp_path / "some")).manifest()["model"] == "dummy"
    exact, near = (search(spark, str(tmp_path / "some"), "open a gate", "semantic", 3, approximate=x).collect() for x in (False, True))
    assert len(exact) == 3 and near


def test_lines_end_at_line_feeds_alone():
    text = "x = 1\n\x0c\ndef a():\n    return 1\n\u2028\nclass B:\n    def m(self):\n        pass\n".replace("\u2028", "# \u2028 z")
    for c in chunking.chunk_text("a.py", text, "python"):
        assert c["body"].startswith(("def a():", "class B:", "def m(self):")) and text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["body"]
        assert c["body"].split("\n")[0] == text.split("\n")[c["line_start"]].strip()


def test_detect_and_state(spark):
    state = spark.createDataFrame([("a", "h1", [1, 2]), ("b", "h2", [3, 4]), ("c", "h3", [5])], "path string, content_hash string, chunk_ids array<bigint>").withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    left, ids = incremental.apply_deletions(state, spark.createDataFrame([("a",), ("c",)], "path string"))
    assert {r.chunk_id for r in ids.collect()} == {1, 2, 5} and [r.path for r in left.collect()] == ["b"]
    files = spark.createDataFrame([("a", 1, None), ("b", 2, "H2"), ("d", 1, "x"), ("c", 2, None)], "path string, t int, content_hash string").withColumn("mtime", F.timestamp_seconds("t"))
    got = {r.path: r.status for r in incremental.detect_changes(files, state).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "d": "changed", "c": "changed"}
    assert {r.status for r in incremental.detect_changes(files.limit(0), state).collect()} == {"deleted"}
    empty = incremental.empty_state(spark)
    assert [r.status for r in incremental.detect_changes(files.limit(1), empty).collect()] == ["changed"]


def test_stream_of_events(spark, tree, tmp_path):
    index = str(tmp_path / "live")
    e = DummyEmbedder(8)
    source = tmp_path / "events"
    source.mkdir()

    def send(n, rows):
        (source / f"{n}.json").write_text("".join(json.dumps(dict(zip(("path", "op", "ts", "seq"), r))) + "\n" for r in rows))

    box, gate = f"file:{tree}/src/box.py", f"file:{tree}/src/gate.rs"
    send(1, [(box, "changed", "2024-01-01T00:00:00Z", 1), (box, "changed", "2024-01-01T00:00:00Z", 2), (gate, "deleted", "2024-01-01T00:00:01Z", 3), (gate, "changed", "2024-01-01T00:00:02Z", 4)])

    def run():
        events = spark.readStream.schema("path string, op string, ts timestamp, seq bigint").json(str(source))
        watch.watch_events(events, index, str(tmp_path / "cp"), e, None).awaitTermination()
        return {r.name for r in IndexStore(spark, index).read("chunks").collect()}

    assert {"Box", "open_gate"} <= run()
    send(2, [(gate, "deleted", "2024-01-01T00:00:03Z", 5)])
    assert "Box" in (names := run()) and "open_gate" not in names


def test_watch_directory(spark, tree, tmp_path):
    index = str(tmp_path / "ticks")
    query = watch.watch_directory(spark, str(tree), index, str(tmp_path / "ticks-cp"), embedder=DummyEmbedder(8), interval="1 second")
    try:
        until = time.time() + 90
        while time.time() < until and not index_status(spark, index)["exists"]:
            time.sleep(0.5)
    finally:
        query.stop()
    assert index_status(spark, index)["files"] == 2


def test_native_events(spark):
    rows = spark.createDataFrame([("a", "Create", 1, 1), ("a", "Access", 1, 2), ("b", "remove", 1, 3)], "path string, event string, ts int, seq int")
    assert {(r.path, r.op) for r in watch.convert_events(rows).collect()} == {("a", "changed"), ("b", "deleted")}


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    assert load(str(path)) == Config() and path.exists()
    Config(top_k=7, exclude_patterns=["*.x"]).save(str(path))
    assert load(str(path)).top_k == 7 and load(str(path)).exclude_patterns == ["*.x"]


def test_wrappers(spark, tree, tmp_path):
    from sondage.server import Service, answer, call

    s = Service(spark, str(tree), str(tmp_path / "i"), Config(model="dummy"))
    assert answer(s, "GET", "/health", b"")[0] == 200
    assert answer(s, "POST", "/search", b'{"query": "x"}')[0] == 404
    assert answer(s, "POST", "/index", b"{}")[1]["changed"] == 2
    assert answer(s, "POST", "/search", b'{"query": "open", "mode": "nope"}')[0] == 400
    assert answer(s, "POST", "/search", b'{"query": "[", "mode": "text"}')[0] == 400
    assert answer(s, "POST", "/search", b'{"query": "open", "mode": "text"}')[1]["total"] > 0
    assert answer(s, "GET", "/none", b"")[0] == 404
    assert call(s, {"id": 1, "method": "tools/list"})["result"]["tools"]
    text = call(s, {"id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "open", "mode": "text"}}})["result"]["content"][0]["text"]
    assert "open" in text
    assert call(s, {"id": 3, "method": "x"})["error"]["code"] == -32601
    assert call(s, {"method": "initialized"}) is None
