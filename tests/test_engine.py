"""The engine end to end on a small folder: sync, search, incremental change, removal, compaction, streaming."""

import json
import time

import pytest

from corvane.config import Config
from corvane.operators import fulltext
from corvane.plans.engine import Engine
from corvane.streaming import events

FILES = {
    "auth.py": "class Login:\n    def check_password(self, user):\n        return verify_token(user)\n",
    "db.py": "import auth\n\ndef open_pool(size):\n    return size\n\ndef verify_token(user):\n    return open_pool(1)\n",
    "notes.txt": "the cache holds rendered pages for the web server\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).write_text(text)
    return root


def test_life_of_an_index(spark, project, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), Config(top_k=5))
    assert engine.sync(str(project)) == {"new": 3}
    assert engine.sync(str(project)) == {"same": 3}
    best = engine.search("rendered pages cache", "balanced").orderBy("rank").first()
    assert best["path"] == "notes.txt"
    assert engine.search_files("verify_token", "fast", 3).orderBy("rank").first()["path"] in ("auth.py", "db.py")
    assert {r["path"] for r in engine.search("verify_token", "thorough").collect()} >= {"auth.py", "db.py"}
    assert engine.symbol("open_pool").first()["kind"] == "function"
    assert {r["direction"] for r in engine.refs("verify_token").collect()} == {"in", "out"}
    assert [r["path"] for r in engine.find_files("*.py").collect()] == ["auth.py", "db.py"]
    assert engine.regex(str(project), "def \\w+").count() == 3
    assert engine.match("rendered AND cache").count() == 1
    time.sleep(1.1)
    (project / "notes.txt").write_text("nothing of interest here any more, only text\n")
    assert engine.sync(str(project)) == {"changed": 1, "same": 2}
    assert engine.match("rendered").count() == 0
    assert engine.status().first()["deleted"] == 1
    engine.remove(["auth.py"])
    assert engine.symbol("Login").count() == 0
    engine.compact()
    ids = {r["chunk_id"] for r in engine.live_chunks().collect()}
    time.sleep(1.1)
    (project / "extra.py").write_text("def brand_new():\n    pass\n")
    engine.sync(str(project))
    fresh = {r["chunk_id"] for r in engine.live_chunks().filter("path = 'extra.py'").collect()}
    assert fresh and min(fresh) > max(ids)


def test_stream_equals_batch(spark, tmp_path):
    rows = [
        {"path": "a", "change_type": c, "ts": f"2024-01-01T00:00:0{i}.000Z"} for i, c in enumerate(("created", "modified", "deleted", "created"))
    ] + [{"path": "b", "change_type": "created", "ts": "2024-01-01T00:00:00.000Z"}, {"path": "z", "change_type": "created", "ts": "2024-01-01T02:00:00.000Z"}]
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    batch = events.debounce(spark.read.schema(events.EVENT).json(str(folder)), "5 seconds").filter("path <> 'z'")
    stream = events.debounce(events.read_events(spark, str(folder)), "5 seconds")
    query = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("debounced").collect()} == {tuple(r) for r in batch.collect()}
    assert {(r["path"], r["change_type"]) for r in batch.collect()} == {("a", "deleted"), ("b", "created")}


def test_watch_routes(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = [("a", "created", 0), ("node_modules/x", "created", 0), ("b", "deleted", 0), ("end", "created", 7200)]
    (folder / "1.json").write_text("\n".join(json.dumps({"path": p, "change_type": c, "ts": f"2024-01-01T0{t // 3600}:00:00Z"}) for p, c, t in rows))
    seen = {"index": [], "remove": []}
    query = events.watch(
        events.read_events(spark, str(folder)), lambda df, n: seen["index"].extend(r["path"] for r in df.collect()), lambda df, n: seen["remove"].extend(r["path"] for r in df.collect()),
        str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    assert seen == {"index": ["a"], "remove": ["b"]}


def test_last_and_priority(spark):
    rows = [("p", c, i) for i, c in enumerate(("created", "modified", "deleted", "created"))]
    df = spark.createDataFrame(rows, "path string, change_type string, ts int")
    assert events.by_priority(df).first()["change_type"] == "deleted"
    assert events.last_per_path(df).first()["change_type"] == "created"


def test_kept_index_finds_what_tokenising_finds(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for i in range(12):
        (root / f"n{i}.txt").write_text(f"caching of pages {i} " + "server " * (i % 4) + ("cafés open" if i % 3 else "tokens verified") + "\n")
    engine = Engine(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, "cached page"), (1, "cafe server"), (2, "verify tok"), (3, ""), (4, None), (5, "absent")], "query_id int, query string")

    def same():
        chunks, kept = engine.live_chunks(), engine.inverted()
        for search in (fulltext.bm25, fulltext.prefix_search):
            found = {tuple(r) for r in search(chunks, asked, kept=kept).collect()}
            assert found == {tuple(r) for r in search(chunks, asked, stemmed=True).collect()} and found
        assert kept.lengths.count() == chunks.count()

    engine.sync(str(root))
    time.sleep(1.1)
    (root / "n1.txt").write_text("the server verifies cached pages twice\n")
    (root / "n2.txt").unlink()
    engine.sync(str(root))
    assert engine.store.segments("postings", 1) == [1]
    same()
    engine.compact()
    assert engine.store.segments("postings", 2) == []
    same()
    # few terms are pushed to the scan
    plan = fulltext.bm25(engine.live_chunks(), asked, kept=engine.inverted())._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and "content" not in plan
    # a folder from before there was a kept index gets it whole
    for name in ("postings", "lengths"):
        engine.store._fs.delete(engine.store._path(f"{engine.store.root}/{name}"), True)
    assert engine.inverted() is None
    engine._add_postings(engine.live_chunks().limit(0))
    assert engine.inverted().lengths.count() == engine.live_chunks().count()
