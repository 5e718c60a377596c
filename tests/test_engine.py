"""A small tree from files to answers, and what changes bring."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lumengraph import engine as E
from lumengraph.operators import search
from lumengraph.sources import files, tree
from lumengraph.sources.store import Store
from lumengraph.streaming import watch as W


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def test_index_ask_and_change(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    write(root, "crates/core/Cargo.toml", '[package]\nname = "core"\n')
    write(root, "crates/core/src/lib.rs", "pub mod db;\nuse crate::db::open_store;\npub fn start() { open_store(); }\n")
    write(root, "crates/core/src/db.rs", 'pub fn open_store() { std::fs::write("cache.db", "x"); }\n')
    write(root, "target/skip.rs", "fn no() {}")
    write(root, "web/util.ts", "export function paint() { return 1; }\n")
    write(root, "web/app.ts", "import {paint as p} from './util';\nexport function draw() { p(); }\n")
    engine = E.Engine(spark, str(root), store)
    assert engine.index() == 5 and engine.index() == 0
    nodes, edges = engine.graph()
    ids = {r.id for r in nodes.collect()}
    assert "crates/core/src/lib.rs:start" in ids and not any("skip" in i for i in ids)
    links = {(r.source, r.target, r.relation) for r in edges.collect()}
    assert ("crates/core/src/lib.rs:start", "crates/core/src/db.rs:open_store", "Calls") in links
    assert ("file:crates/core/src/lib.rs", "file:crates/core/src/db.rs", "Imports") in links
    assert ("crates/core/src/db.rs:open_store", "artifact:cache.db", "Writes") in links
    assert ("web/app.ts:draw", "web/util.ts:paint", "Calls") in links and ("file:web/app.ts", "file:web/util.ts", "Imports") in links
    assert engine.ask("open store", 5).first().id == "crates/core/src/db.rs:open_store"
    engine.register()
    found = [r.id for r in spark.sql("SELECT id FROM search('open store', 5) ORDER BY place").collect()]
    assert found and found == [r.id for r in search.bm25_indexed(engine.words(), ["open", "store"], 5).collect()]
    assert spark.sql("SELECT * FROM trace_calls('open_store')").count() == 1
    assert engine.grep("fn +START", True).count() == 1 and engine.skeleton("db.rs").count() == 1
    assert engine.trace("open_store").count() == 1 and engine.freshness(None).first().path == "(no cache)"
    assert engine.wiring()[0] == 1

    write(root, "crates/core/src/db.rs", "pub fn renamed() {}\n")
    (root / "crates/core/Cargo.toml").unlink()
    assert engine.index() == 1
    ids = {r.id for r in engine.tables()["nodes"].collect()}
    assert "crates/core/src/db.rs:renamed" in ids and "crates/core/src/db.rs:open_store" not in ids and not any("Cargo.toml" in i for i in ids)


def test_packages_pictures_and_reports(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    write(root, "Cargo.toml", '[workspace]\n[workspace.dependencies]\ncore-lib = { path = "crates/core" }\n')
    write(root, "crates/core/Cargo.toml", '[package]\nname = "core-lib"\n')
    write(root, "crates/core/src/lib.rs", "pub mod db;\npub fn start() { open_all(); }\nfn open_all() {}\n")
    write(root, "crates/core/src/db.rs", "pub fn only_here() {}\n")
    write(root, "crates/app/Cargo.toml", '[package]\nname = "app"\n[dependencies]\ncore-lib = { path = "../core" }\nfar = { path = "../../../other/far", optional = true }\n[dev-dependencies]\nx = { path = "../x" }\n')
    write(root, "crates/app/src/main.rs", "use core_lib::start;\nfn main() { start(); only_here(); }\n")
    write(root, ".harness/hedefler.json", '{"schema": "goals/1", "features": [{"id": "A", "status": "done"}]}')
    engine = E.Engine(spark, str(root), store)
    engine.index()
    nodes, edges = engine.graph()
    links = {(r.source, r.target, r.relation): r.confidence for r in edges.collect()}
    app, core = "crates/app/Cargo.toml:app", "crates/core/Cargo.toml:core-lib"
    assert links[app, core, "DependsOn"] == 1.0 and links[app, "ext:other/far", "DependsOn"] == 0.5
    assert engine.node("ext:other/far").first().kind == "ExternalCrate"
    # By scope, and by what a direct dependency makes public.
    assert abs(links["crates/app/src/main.rs:main", "crates/core/src/lib.rs:start", "Calls"] - 0.90) < 1e-6
    assert abs(links["crates/app/src/main.rs:main", "crates/core/src/db.rs:only_here", "Calls"] - 0.60) < 1e-6
    record = engine.diagram()
    assert {c["id"]: c["role"] for c in record["components"]} == {"app": "Frontend", "core-lib": "Backend", "ext:other/far": "External"}
    assert {(x["from"], x["to"], x["line_style"], x["weight"]) for x in record["connections"]} == {("app", "core-lib", "", 1), ("app", "ext:other/far", "dashed", 0)}
    assert [b["nodes"] for b in engine.tour(record)] == [["app"], ["core-lib"], ["ext:other/far"]] and len(record["regions"]) == 2
    assert {c["label"] for c in engine.diagram(package="core-lib")["components"]} == {"lib", "db"} and engine.diagram(package="none") is None
    assert engine.diagram("dataflow")["components"] and engine.diagram("sequence")["messages"][0]["to"] == "crates/core/src/lib.rs:start"
    path, size = engine.render(str(tmp_path / "a.svg"))
    assert (tmp_path / "a.svg").read_text().startswith("<svg") and (tmp_path / "a.svg").stat().st_size == size
    page, _ = engine.render(str(tmp_path / "s.html"), "sequence")
    assert "<svg" in open(page).read()
    assert engine.declarations("ONLY_HERE", True).first().refs >= 1
    assert engine.write_wiring(str(tmp_path / "w")) == (tmp_path / "w").stat().st_size
    assert {r.what for r in engine.stats().collect()} == {"node", "edge", "language"}
    assert engine.board_lines().first().line.startswith("1 goals · 1 done") and '"green":true' in engine.board_json().first().json and "done" in engine.board_report().first().report


def test_last_hashes_of_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 2)], "path string, hash bigint, modificationTime int")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = W.last_hashes(stream).writeStream.outputMode("complete").format("memory").queryName("hashes").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("hashes").collect()} == {("a", 2), ("b", 3)}


def test_requests(spark, tmp_path):
    engine = E.Engine(spark, str(tmp_path), str(tmp_path / "none"))
    ask = lambda **r: json.loads(E.answer(engine, json.dumps(r)))
    assert "ask" in ask(id=1, method="tools/list")["result"]["tools"]
    assert ask(id=2, method="nope")["error"]["code"] == -32601 and json.loads(E.answer(engine, "{"))["error"]["code"] == -32700
    assert E.answer(engine, json.dumps({"method": "tools/list"})) is None
    assert "index again" in ask(id=3, method="tools/call", params={"name": "file_api", "arguments": {"file": "x"}})["error"]["message"]


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(files.StaleCacheError):
        store.current()
    one = spark.createDataFrame([("a.rs", "r1"), ("b.rs", "r1")], "path string, segment string")
    first = store.write(spark.createDataFrame([("a.rs", 1), ("b.rs", 2)], "path string, n int"), "rows")
    store.commit({"files": store.write(one.withColumn("segment", F.lit(first)), "files")}, [first])
    assert {tuple(r) for r in store.rows().collect()} == {("a.rs", 1), ("b.rs", 2)}
    # A run that dies between its tables leaves the old state; the next run sweeps what it left.
    before = store.rows()
    lost = store.write(spark.createDataFrame([("a.rs", 9)], "path string, n int"), "rows")
    assert {tuple(r) for r in store.rows().collect()} == {("a.rs", 1), ("b.rs", 2)}
    second = store.write(spark.createDataFrame([("a.rs", 3)], "path string, n int"), "rows")
    live = spark.createDataFrame([("a.rs", second)], "path string, segment string")
    store.commit({"files": store.write(live, "files")}, [first, second])
    assert {tuple(r) for r in store.rows().collect()} == {("a.rs", 3)} and not (tmp_path / "s" / lost).exists()
    assert before.count() == 2  # the state before can still be read
    store.commit({"files": store.write(live, "files")}, [second])
    store.commit({"files": store.write(live, "files")}, [second])
    assert not (tmp_path / "s" / first).exists() and len(store.numbers()) == 2
    (tmp_path / "s" / "_snapshots" / "0000000099.json").write_text('{"number": 99, "tables": {}, "segments": [], "format": 98}')
    with pytest.raises(files.StaleCacheError):
        store.current()


def test_two_runs_cannot_take_one_number(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    folder = store.write(spark.createDataFrame([("a", "x")], "path string, segment string"), "files")
    store.commit({"files": folder}, [])
    monkeypatch.setattr(store, "numbers", list)
    with pytest.raises(RuntimeError):
        store.commit({"files": folder}, [])
    monkeypatch.undo()
    assert store.current().number == 1


def test_listing_leaves_folders_out(spark, tmp_path):
    for path in ("a/b/c/x.rs", "a/y.py", "z.go", "target/t.rs", "a/node_modules/m.js", ".git/g.rs", ".claude/skills/s/SKILL.md", "docs/diyagramlar/d.rs", "diyagramlar/e.rs", "x-out/o.rs", "a/.hidden.rs", "a/note.txt", "Cargo.toml"):
        write(tmp_path, path, path)
    want = {"a/b/c/x.rs", "a/y.py", "z.go", ".claude/skills/s/SKILL.md", "diyagramlar/e.rs", "Cargo.toml"}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = tree.listing(spark, root)
        assert {r.path for r in rows.collect()} == want
        assert {r.path: bytes(r.content).decode() for r in tree.opened(rows, root).collect()} == {p: p for p in want}
    assert {r.path for r in tree.listing(spark, str(tmp_path), True).collect()} == want | {"a/note.txt"}
    at, _ = tree.connect(str(tmp_path))
    entered = []

    class Told:
        def get_file_info(self, selector):
            entered.append(selector.base_dir.removeprefix(str(tmp_path)))
            return at.get_file_info(selector)

    reader = tree.Reader(str(tmp_path), 2)
    shares = reader.partitions()
    assert sorted(r for share in shares for batch in reader.read(share) for r in batch.column(0).to_pylist()) == sorted(want | {"a/note.txt"})
    folders = [""]
    while folders:
        folders += tree.listed(Told(), str(tmp_path), folders.pop())[0]
    assert not any(x in e for e in entered for x in ("target", "node_modules", ".git", "x-out", "docs/d"))
    gone = spark.createDataFrame([("a/y.py",), ("a/none.py",)], "path string")
    assert [r.path for r in tree.opened(gone, str(tmp_path)).collect()] == ["a/y.py"]
    assert tree.listing(spark, str(tmp_path / "nothing")).count() == 0


def test_unchanged_files_are_not_opened(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    for k in range(4):
        write(root, f"m{k}.py", f"def f{k}(): pass\n")
    old = time.time() - 1000
    for k in range(4):
        os.utime(root / f"m{k}.py", (old, old))
    assert W.index(spark, str(root), store) == 4
    held = Store(spark, store)
    folders = sorted(os.listdir(store))
    # Same size and time, other content: a run that opened it would see that.
    write(root, "m0.py", "def xx(): pass\n")
    os.utime(root / "m0.py", (old, old))
    assert W.index(spark, str(root), store) == 0 and sorted(os.listdir(store)) == folders and held.numbers() == [1]
    os.utime(root / "m1.py", (old + 5, old + 5))  # touched alone: opened, and found unchanged
    assert W.index(spark, str(root), store) == 0 and held.numbers() == [1]
    write(root, "m1.py", "def g(): pass\n")
    (root / "m2.py").unlink()
    write(root, "m4.py", "def new(): pass\n")
    kept = held.current().segments
    assert W.index(spark, str(root), store) == 2
    assert held.current().segments[: len(kept)] == kept and len(held.current().segments) == 2  # only what is new is written
    names = {r.name for r in W.rows(spark, store).where("tag = 'node' AND kind = 'Function'").collect()}
    assert names == {"f0", "g", "f3", "new"}
    assert {(r.path, r.change) for r in held.table("changes").collect()} == {("m1.py", "changed"), ("m2.py", "deleted"), ("m4.py", "new")}


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SEGMENTS", 2)
    root, store = tmp_path / "tree", str(tmp_path / "store")
    for k in range(4):
        write(root, f"m{k}.py", f"def f{k}(): pass\n")
        assert W.index(spark, str(root), store) == 1
    assert len(Store(spark, store).current().segments) <= 2
    assert {r.name for r in W.rows(spark, store).where("kind = 'Function'").collect()} == {f"f{k}" for k in range(4)}


def test_files_as_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    shape = "path string, hash bigint, at timestamp"
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    found = []

    def batch(rows):
        made = [(p, h, datetime.datetime(2024, 1, 1, 0, 0, t)) for p, h, t in rows]
        spark.createDataFrame(made, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = W.file_changes(stream, "10 seconds", "5 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        query = changed.trigger(availableNow=True).foreachBatch(lambda df, n: found.extend(df.collect())).start()
        assert query.awaitTermination(120)
        out = {(r.path, r.change, r.hash) for r in found}
        found.clear()
        return out

    try:
        assert batch([("a", 1, 1), ("b", 5, 1), ("b", 5, 3), ("b", None, 4)]) == {("a", "new", 1), ("b", "new", 5), ("b", "deleted", None)}
        # A return, old news and a path that nobody knew; a path that comes and goes and comes.
        assert batch([("b", 6, 5), ("a", 1, 1), ("a", 2, 2), ("c", None, 5), ("d", 1, 6), ("d", None, 7), ("d", 2, 8)]) == {("b", "returned", 6), ("a", "changed", 2), ("d", "new", 1), ("d", "deleted", None), ("d", "returned", 2)}
        assert batch([("b", None, 9), ("b", None, 10), ("e", 1, 40)]) == {("b", "deleted", None), ("e", "new", 1)}
        assert batch([("b", 6, 41)]) == {("b", "new", 6)}  # its tombstone has expired
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_watch_keeps_up(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    write(root, "a.py", "def f(): pass\n")
    engine = E.Engine(spark, str(root), store)
    query = engine.watch(1)
    try:
        end = time.time() + 90  # the ticks never run out, so wait for the first round's tables
        while time.time() < end and not list((tmp_path / "store").glob("_snapshots/*.json")):
            time.sleep(1)
        assert engine.tables()["nodes"].where("name = 'f'").count() == 1
    finally:
        query.stop()
