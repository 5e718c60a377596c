"""Operators on small inputs written by hand: source files, specs, boards, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph import engine
from lumengraph.functions import paths as P
from lumengraph.operators import diagrams, extract, imports, resolve, rollup, tours
from lumengraph.sources import board

FILES = {
    "crates/core/Cargo.toml": '[package]\nname = "core-lib"\n[dependencies]\nutil = { path = "../util", optional = true }\nserde = "1"\n[dev-dependencies]\nfake = { path = "../fake" }\n[workspace]\n',
    "crates/core/src/lib.rs": (
        "use crate::db::Store;\nuse util::{text, fold as f};\n/// Opens.\npub fn open(path: &str) -> Store {\n    let s = Store::new(path);\n    s.load();\n    db::check(&s);\n    helper(s)\n}\n"
        'fn helper(s: Store) -> Store { std::fs::write("state.db", "x"); s }\npub struct Point { x: u8 }\nimpl Point {\n    pub fn len(&self) -> u8 { self.size() }\n}\n#[test]\nfn checks() { open("a"); }\n'
    ),
    "app/main.py": "from .store import load as read\nimport app.tools\n\nclass Door:\n    def __init__(self):\n        self.open()\n\n    def open(self):\n        return read('x')\n\ndef run():\n    Door()\n    tools.start()\n",
    "web/view.ts": "import {paint as p} from './util';\nexport class View {\n  draw() { return p(1); }\n}\nexport function show() { const v = new View(); v.draw(); }\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"host.io/x/store"\n)\n\nfunc Serve() {\n\tstore.Open()\n\tfmt.Println("x")\n\tstep()\n}\n\nfunc step() {}\n',
    "jv/a/Box.java": "package a;\n\nimport a.b.Item;\n\npublic class Box {\n    public Item first() { return new Item(); }\n    private void hide() { first(); }\n}\n",
    "c/util.c": '#include "util.h"\n\nint twice(int x) { return add(x, x); }\n\nstatic int add(int a, int b) { return a + b; }\n',
    ".claude/skills/notes/SKILL.md": "# Notes\nwrites govde.txt and reads paper.pdf\n",
    "lib/paper.pdf": "%PDF",
    "lib/words.sqlite": "",
}


def _rows(spark: SparkSession) -> DataFrame:
    return extract.tagged(spark.createDataFrame(list(FILES.items()), "path string, text string"))


def extracted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and documents of ten files."""
    return extract.tables(_rows(spark))["nodes"].select("id", "kind", F.col("span.start_line").alias("line"))


def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, visibility, lines, bindings, data files."""
    return extract.tables(_rows(spark))["facts"].select("node_id", "tag", F.coalesce("value", F.lit("")).alias("value"))


def extracted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import specs and manifest lines."""
    return extract.tables(_rows(spark))["imports"].select("file_id", "pos", "spec")


def ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and scripts that name documents."""
    return extract.ecosystem_links(extract.tables(_rows(spark))["nodes"])


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules for test code, kept apart."""
    paths = ["src/tests.rs", "a/tests/x.rs", "a/test/x.py", "x.test.ts", "a/spec/x.js", "benches/b.rs", "a/fixtures/c.rs", "src/contest.rs", "pkg/x_test.go", "ATest.java"]
    told = [(p, extract.rust_test_path(p), extract.other_test_path(p)) for p in paths]
    return spark.createDataFrame(told, "path string, rust boolean, other boolean").select("path", "rust", "other", (~P.in_product(F.col("path"))).alias("package"))


# Imports


def _paths(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _specs(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "file string, spec string")


def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    files = _paths(spark, "web/a.ts", "web/b.tsx", "web/lib/index.js", "web/c.mjs", "/abs/x.js", "/abs/y/z.ts")
    return imports.script_imports(_specs(spark, ("web/a.ts", "./b"), ("web/a.ts", "./lib"), ("web/lib/index.js", "../c.mjs"), ("web/a.ts", "./none"), ("web/a.ts", "react"), ("/abs/x.js", "./y/z")), files)


def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    files = _paths(spark, "app/main.py", "app/store.py", "app/sub/__init__.py", "app/sub/deep.py", "lib/only.py", "x/both.py", "y/both.py")
    return imports.python_imports(_specs(spark, ("app/main.py", ".store"), ("app/main.py", ".sub"), ("app/sub/deep.py", "..store"), ("app/main.py", "lib.only"), ("app/main.py", "os.path"), ("app/sub/deep.py", ".")), files)


def python_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted tails of up to five names, two files at most."""
    files = _paths(spark, "lib/only.py", "x/both.py", "y/both.py", "a/t.py", "b/t.py", "c/t.py", "r/a/b/c/d/e.py")
    return imports.python_bindings(_specs(spark, ("m.py", "only"), ("m.py", "lib.only"), ("m.py", "both"), ("m.py", "t"), ("m.py", "a.b.c.d.e"), ("m.py", "r.a.b.c.d.e"), ("m.py", ".only")), files)


def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by their last parts."""
    files = _paths(spark, "m/x/store/a.go", "m/x/store/b.go", "m/y/store/c.go", "m/solo/d.go", "m/cmd/e.go", "store/f.go")
    return imports.go_imports(_specs(spark, ("m/cmd/e.go", "host.io/x/store"), ("m/cmd/e.go", "solo"), ("m/cmd/e.go", "host.io/solo"), ("m/cmd/e.go", "m/solo"), ("m/cmd/e.go", "store"), ("m/cmd/e.go", "fmt")), files)


def java_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class's files, else a package's."""
    files = _paths(spark, "jv/a/b/Item.java", "old/a/b/Item.java", "jv/a/c/One.java", "jv/a/c/Two.java")
    return imports.java_imports(_specs(spark, ("jv/M.java", "a.b.Item"), ("jv/M.java", "a.c"), ("jv/M.java", "java.util.List")), files)


def c_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header near, else by its end, and the sources beside it."""
    files = _paths(spark, "c/util.h", "c/util.c", "c/main.c", "inc/net/sock.hpp", "inc/net/sock.cpp", "inc/net/sock.cc", "other/util.h")
    return imports.c_imports(_specs(spark, ("c/main.c", "util.h"), ("c/main.c", "net/sock.hpp"), ("c/main.c", "stdio.h")), files)


def rust_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest module prefix, climbing, library before program, names by folder, package and suffix."""
    files = ("w/core/src/lib.rs", "w/core/src/main.rs", "w/core/src/db/mod.rs", "w/core/src/db/rows.rs", "w/core/src/db/deep/leaf.rs", "w/util/src/lib.rs", "w/util/src/text.rs", "src/top.rs")
    nodes = spark.createDataFrame([(f, "File") for f in files], "path string, kind string")
    specs = [
        ("w/core/src/lib.rs", "crate::db::rows::Row"), ("w/core/src/db/rows.rs", "super::super::run"), ("w/core/src/db/rows.rs", "super::deep::leaf::x"), ("w/core/src/db/mod.rs", "self::rows"), ("w/core/src/lib.rs", "my_tools::text::fold"),
        ("w/core/src/db/rows.rs", "big_util::text"), ("w/util/src/text.rs", "core::db"), ("w/util/src/lib.rs", "std::fs"), ("src/top.rs", "crate::top"),
    ]
    rows = spark.createDataFrame([(f"file:{f}", f"rs:{s}") for f, s in specs], "file_id string, spec string")
    packages = spark.createDataFrame([("p1", "w/util", "my_tools")], "id string, dir string, code_name string")
    return engine.rust_imports(nodes, rows, packages)


# Calls


def other_language_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token shape of the other languages."""
    defs = [
        ("a:draw", "draw", "Function", "web/a.ts", "web", None, True, "js"), ("a:own", "own", "Function", "web/a.ts", "web", None, False, "js"), ("u:paint", "paint", "Function", "web/util.ts", "web", None, True, "js"),
        ("u:View", "View", "Class", "web/util.ts", "web", None, True, "js"), ("u:View::constructor", "constructor", "Method", "web/util.ts", "web", "View", False, "js"), ("u:View::refresh", "refresh", "Method", "web/util.ts", "web", "View", False, "js"),
        ("g:Serve", "Serve", "Function", "srv/main.go", "srv", None, True, "go"), ("h:step", "step", "Function", "srv/help.go", "srv", None, False, "go"),
    ]
    shape = "id string, name string, kind string, file string, dir string, owner string, is_pub boolean, lang string"
    frame = spark.createDataFrame(defs, shape)
    tokens = [("a:draw", k, t, "web/a.ts", "web", "js", None) for k, t in enumerate(("own", "p", "new:View", "util.paint", ".refresh", "ext", "push", "console.log", "View.refresh", ".push"))]
    tokens += [("g:Serve", k, t, "srv/main.go", "srv", "go", None) for k, t in enumerate(("step", "none"))]
    calls = spark.createDataFrame(tokens, "caller string, tok_ord int, token string, file string, dir string, lang string, owner string")
    linked = spark.createDataFrame([("web/a.ts", "web/util.ts")], "file string, other_file string")
    bound = spark.createDataFrame([("web/a.ts", "p", "paint", "web/util.ts"), ("web/a.ts", "util", "*", "web/util.ts"), ("web/a.ts", "View", "View", "web/util.ts")], "file string, local string, original string, other_file string")
    external = spark.createDataFrame([("web/a.ts", "ext")], "file string, local string")
    return imports.resolve_other(calls, frame.drop("lang"), linked, bound, external).drop("tok_ord")


def artifact_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader without a name takes those of what it calls; names without reading make no edge."""
    functions = spark.createDataFrame([(x,) for x in ("reader", "writer", "helper", "idle")], "id string")
    io = spark.createDataFrame([("reader", "r"), ("writer", "w"), ("gone", "w")], "id string, op string")
    names = spark.createDataFrame([("helper", "state.db"), ("writer", "out.csv"), ("idle", "x.db"), ("gone", "y.db")], "id string, artifact string")
    calls = spark.createDataFrame([("reader", "helper"), ("idle", "helper")], "source string, target string")
    return resolve.artifact_flow(functions, io, names, calls)


# Paths


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined paths, the folder below a common one, module names."""
    rows = [("/a/b", "../c/./d"), ("a/b", "../../../x"), ("", "y/z"), ("w/core", "../../far/lib"), ("w/core", "../core"), ("C:/a", "b"), ("w/core/x", "../..")]
    frame = spark.createDataFrame(rows, "base string, spec string").withColumn("joined", P.join_norm(F.col("base"), F.col("spec")))
    return frame.select("base", "spec", "joined", P.sibling_repo(F.col("base"), F.col("joined")).alias("repo"), P.module_name(F.concat("joined", F.lit("/mod.rs"))).alias("module"))


def shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all files share, without a source folder at its end."""
    cases = {"one": ["r/w/src/a.rs", "r/w/src/b/c.rs"], "two": ["r/x/a.rs", "r/y/b.rs"], "none": ["a.rs", "b/c.rs"], "empty": []}
    return spark.createDataFrame([(k, *rollup.common_prefix(spark.createDataFrame([(f,) for f in files], "path string"))) for k, files in cases.items()], "name string, n int, root string")


# Pictures


GRAPHS = {"chain": (3, [(0, 1), (1, 2)]), "skip": (3, [(0, 2), (0, 1), (1, 2)]), "cycle": (2, [(0, 1), (1, 0)]), "cross": (5, [(0, 3), (1, 2), (0, 4)]), "late": (4, [(3, 0), (0, 1), (2, 1)])}


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers from the sources and from the first node, and places after sorting by neighbours."""
    rows = []
    for name, (n, edges) in GRAPHS.items():
        level = diagrams.layers(n, edges)
        place = {v: k for own in diagrams.ordered_columns(level, edges) for k, v in enumerate(own)}
        rows += [(name, v, level[v], diagrams.layers(n, edges, True)[v], place[v]) for v in range(n)]
    return spark.createDataFrame(rows, "name string, node int, layer int, by_place int, place int")


def sequence_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two roots the one in main.rs; three steps deep; a later call is marked."""
    known = [("x/main.rs", "main", ""), ("y/other.rs", "main", ""), ("x/b.rs", "b", ""), ("x/c.rs", "c", "async fn c()"), ("x/d.rs", "d", ""), ("x/e.rs", "e", "")]
    nodes = spark.createDataFrame([(k, f"{path}:{name}", path, name, "Function", body) for k, (path, name, body) in enumerate(known)], "ord bigint, id string, path string, name string, kind string, search_body string")
    calls = [("x/main.rs:main", "x/b.rs:b"), ("x/b.rs:b", "x/c.rs:c"), ("x/c.rs:c", "x/d.rs:d"), ("x/d.rs:d", "x/e.rs:e"), ("y/other.rs:main", "x/e.rs:e"), ("y/other.rs:main", "x/d.rs:d")]
    edges = spark.createDataFrame([(k, a, b, "Calls") for k, (a, b) in enumerate(calls)], "ord bigint, source string, target string, relation string")
    rows = diagrams.sequence(nodes, edges, "main")["messages"]
    return spark.createDataFrame([(m["order"], m["from"], m["to"], m["action"], m["is_async"]) for m in rows], "place int, caller string, callee string, action string, later boolean")


BOXES = [
    {"key": "cli", "id": "cli", "label": "cli", "external": False, "bin": True, "role": "Frontend", "lines": 100, "api": []},
    {"key": "core", "id": "core", "label": "core", "external": False, "bin": False, "role": "Backend", "lines": 900, "api": ["open", "close"]},
    {"key": "store", "id": "store", "label": "store", "external": False, "bin": False, "role": "Database", "lines": 300, "api": []},
    {"key": "panel", "id": "panel", "label": "panel", "external": False, "bin": False, "role": "Frontend", "lines": 50, "api": []},
    {"key": "ext:far/x", "id": "ext:far/x", "label": "x", "external": True, "bin": False, "role": "External", "lines": 0, "api": []},
]
LINKS = [{"from": "cli", "to": "core", "uses": 3}, {"from": "cli", "to": "panel", "uses": 0}, {"from": "core", "to": "store", "uses": 2}, {"from": "panel", "to": "core", "uses": 5}, {"from": "core", "to": "ext:far/x", "uses": 1}]


def _beats(spark: SparkSession, beats: list[dict]) -> DataFrame:
    return spark.createDataFrame([(b["step"], b["title"], b["description"], " ".join(b["nodes"])) for b in beats], "step int, title string, description string, nodes string")


def package_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, K10, W6."""
    return _beats(spark, tours.package_tour(BOXES, LINKS))


def module_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return _beats(spark, tours.module_tour(BOXES, LINKS))


# Boards


BOARD = '{"schema": "goals/1", "mission": "ship", "features": [{"id": "A", "name": "first", "status": "done"}, {"id": "B", "title": "second", "durum": "kismi", "notes": "half"}, {"name": "third", "status": "???"}, 7]}'


def _board(spark: SparkSession) -> DataFrame:
    return board.goals(spark.createDataFrame([("b.json", bytearray(BOARD.encode()))], "path string, content binary"))


def board_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text of a board."""
    rows = _board(spark)
    return board.report(rows, board.summary(rows, engine.BOARD_SCHEMA))


def board_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the document of a board."""
    rows = _board(spark)
    return board.to_json(rows, board.summary(rows, engine.BOARD_SCHEMA))


def board_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the counts of a board in a line."""
    return board.summary_line(board.summary(_board(spark), engine.BOARD_SCHEMA))


QUERIES = {
    f.__name__: f
    for f in (
        extracted_nodes, extracted_facts, extracted_imports, ecosystem, test_paths, script_imports, python_imports, python_bindings, go_imports, java_imports, c_imports, rust_imports, other_language_calls, artifact_flow,
        path_rules, shared_prefix, layered, sequence_messages, package_tour, module_tour, board_report, board_json, board_line,
    )
}
