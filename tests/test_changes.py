import hashlib

import pytest

from sondage.operators.change_capture import ChangeLog, detect, valid_states
from sondage.operators.ranking import global_rank
from pyspark.sql import functions as F


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


RUNS = [(1, "ok"), (2, "failed"), (3, "ok"), (4, "running")]


def _states(spark):
    rows = [("a", _sha("a"), 1), ("a", _sha("a"), 1), ("a", _sha("old"), 2), ("b", _sha("b1"), 1), ("b", _sha("b2").upper(), 3), ("c", _sha("c"), 2), ("d", None, 3), ("e", _sha("e"), 1), ("f", _sha("f"), 4), (None, "x", 1)]
    state = spark.createDataFrame(rows, "path string, content_hash string, run_id bigint")
    return valid_states(state, spark.createDataFrame(RUNS, "run_id bigint, outcome string"))


def test_detect(spark):
    docs = spark.createDataFrame([("a", "a"), ("b", "b2"), ("c", "c"), ("d", "d"), ("f", "f"), ("g", None), ("h", ""), (None, "x"), ("a", "a")], "file_path string, text string")
    got = {r.path: r.status for r in detect(docs, _states(spark)).collect()}
    assert got == {"c": "new", "d": "changed", "e": "deleted", "f": "new", "g": "new", "h": "new"}


def test_detect_empty(spark):
    docs = spark.createDataFrame([("a", "a")], "file_path string, text string")
    states = _states(spark)
    assert {r.status for r in detect(docs.limit(0), states).collect()} == {"deleted"}
    assert {r.status for r in detect(docs, states.limit(0)).collect()} == {"new"}


def _changes(spark, names, status="new"):
    return spark.createDataFrame([(n, status, "h") for n in names], "path string, status string, content_hash string")


def test_replay_neither_skips_nor_repeats(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), 3)
    seen = []

    def fails(rows, batch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(lambda: _changes(spark, "abcdef"), fails)
    assert log.pending() == ["000000000000"] and log.sink().count() == 0
    again = ChangeLog(spark, str(tmp_path / "log"), 3)
    out = again.run(lambda: _changes(spark, "gh"), lambda rows, batch: seen.append((batch, rows.count())))
    assert seen == [("000000000000", 6), ("000000000001", 2)]
    assert sorted(r.path for r in out.collect()) == list("abcdefgh")
    places = [(r.partition, r.offset) for r in out.collect()]
    assert len(set(places)) == len(places)


def test_sink_keeps_each_key_and_offset_once(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), 2)
    batch = log.plan(_changes(spark, "abc"))
    for _ in range(2):
        log.deliver()
        log._fs.delete(log._path(f"{log.root}/done/{batch}"), False)
    assert log.sink().count() == 3


def test_offsets_go_on_and_the_sink_does_not_grow(spark, tmp_path):
    """A later batch starts where the one before ended, in more partitions if it is larger; a replay replaces its sink."""
    log = ChangeLog(spark, str(tmp_path / "log"), 4)
    log.run(lambda: _changes(spark, "abc"))
    assert {r.partition: r.next_offset for r in log.offsets().collect()} == {0: 3}
    log.run(lambda: _changes(spark, "defghijkl"))
    after = {r.partition: r.next_offset for r in log.offsets().collect()}
    assert len(after) == 3 and sum(after.values()) == 12 and after[0] > 3
    log.run(lambda: _changes(spark, "m"))
    rows = [(r.partition, r.offset) for r in log.sink().collect()]
    assert len(set(rows)) == len(rows) == 13
    for p in {p for p, _ in rows}:
        assert sorted(o for q, o in rows if q == p) == list(range(sum(q == p for q, _ in rows)))
    size = log._read(["sink/000000000001"]).count()
    log._fs.delete(log._path(f"{log.root}/done/000000000001"), False)
    assert log.deliver() == ["000000000001"] and log._read(["sink/000000000001"]).count() == size == 9
    log._fs.delete(log._path(f"{log.root}/offsets/000000000002/_SUCCESS"), False)
    assert log.batches() == ["000000000000", "000000000001"] and sum(r.next_offset for r in log.offsets().collect()) == 12


def test_global_rank(spark):
    rows = [("x", i % 7, i) for i in range(500)] + [("y", 1, 1000), ("z", None, 1001)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    ranked, parts = global_rank(df, ["g"], [F.desc("v"), F.col("id")])
    got = {r.id: (r["rank"], r.group_size) for r in ranked.collect()}
    want = {r[2]: n + 1 for n, r in enumerate(sorted(rows[:500], key=lambda r: (-r[1], r[2])))}
    assert {k: v[0] for k, v in got.items() if k < 500} == want and got[1000] == (1, 1) and got[0][1] == 500
