"""Streams over files that land, the pointer of a second root, argument parsing, and the evaluation commands."""

import json

import pytest

from faultline import api, cli
from faultline.store import SnapshotStore, find_store, leave_pointer
from faultline.streaming.commits import daily_activity, keep_current

ROWS = [("2024-01-01T10:00:00", "a.py", "fix crash"), ("2024-01-01T12:00:00", "a.py", "work"), ("2024-01-02T01:00:00", "a.py", "work"), ("2024-01-09T01:00:00", "b.py", "bug")]


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (t, f, m) in enumerate(ROWS):
        (folder / f"{i}.json").write_text(json.dumps({"committed_at": t, "file": f, "message": m}))
    return str(folder)


def test_daily_activity(spark, landed, tmp_path):
    stream = spark.readStream.schema("committed_at timestamp, file string, message string").json(landed)
    out = daily_activity(stream).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    assert {(r.file, str(r.day)[:10]): (r.commits, r.fixes) for r in spark.table("days").collect()} == {("a.py", "2024-01-01"): (2, 1), ("a.py", "2024-01-02"): (1, 0), ("b.py", "2024-01-09"): (1, 1)}


def test_keep_current(spark, landed, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("committed_at timestamp, file string, message string").json(landed)
    assert keep_current(stream, store, "files", ["file"], str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.file for r in store.read("files").collect()) == ["a.py", "b.py"]


def test_pointer_of_a_second_root(spark, tmp_path):
    first, second = (tmp_path / n for n in ("one", "two"))
    for f in (first, second):
        f.mkdir()
    store = str(first / ".faultline" / "index")
    leave_pointer(spark, str(second), store)
    assert find_store(spark, str(second / ".faultline" / "index")) == store
    assert find_store(spark, store) == store


def test_overlay_cache_reuses_until_head_moves(spark, tmp_path):
    store, made = SnapshotStore(spark, str(tmp_path / "s")), []

    def make():
        made.append(1)
        return spark.range(3)

    for head in ("x", "x", "y"):
        assert store.cached("risk", head, make).count() == 3
    assert len(made) == 2


def test_arguments():
    assert [cli.parse_duration(x) for x in ("2s", "500ms", "7")] == [2000, 500, 7]
    assert cli.parse_weights("0,.5, 1,2") == (0, 0.5, 1, 2)
    assert cli.parser().parse_args(["eval", "risk", ".", "--weights", "1,0,0,0"]).weights == (1, 0, 0, 0)


def test_parse_command(tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n")
    assert cli.main(["parse", str(tmp_path / "a.py")]) == 0
    facts = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(f["fact"], f["name"]) for f in facts] == [("def", "f"), ("ref", "g")]


def test_history_of_several_roots(spark, tmp_path):
    import subprocess

    for name in ("one", "two"):
        root = tmp_path / name
        root.mkdir()
        git = lambda *args, root=root: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *args], check=True, capture_output=True)
        git("init", "-q")
        for text in ("x = 1\n", "x = 2\n"):
            (root / "a.py").write_text(text)
            git("add", "-A")
            git("commit", "-qm", "work")
    got = cli.history_of(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).select("file").collect()
    assert sorted(r.file for r in got) == ["one/a.py", "two/a.py"]


def test_evaluation(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"m{i}.py").write_text((f"from m{i - 1} import f{i - 1}\n\n\n" if i else "") + f"def f{i}():\n    return " + (f"f{i - 1}()" if i else "token_one") + "\n")
    history = spark.createDataFrame([(f"c{s}", s, "x", f"m{(s + j) % 4}.py", s % 2 == 0) for s in range(12) for j in range(2)], "commit string, seq int, author string, file string, is_fix boolean")
    engine = api.Engine.index_roots(spark, [str(tmp_path)], history)
    recall = engine.evaluate_recall(history, 4).first()
    # Imports lead from a module to the one before, calls over up to three of them.
    assert recall.pairs == 8 and recall.static == 0.5 and recall.fused >= max(recall.static, recall.cochange)
    assert {r.term for r in engine.evaluate_risk(history, 4).collect()} == {"churn", "bug_density", "ownership", "fanout"}
    assert engine.evaluate_risk(history, 4, (0, 0, 0, 1)).first().term == "composite"
    texts = spark.createDataFrame([(f"m{i}.py", (tmp_path / f"m{i}.py").read_text()) for i in range(4)], "file string, text string")
    out = {r.ranking: r for r in engine.evaluate_grep(history, texts, 4).collect()}
    assert set(out) == {"impact", "identifiers", "chance"} and out["chance"].recall == 1 and 0 < out["impact"].recall <= 1
