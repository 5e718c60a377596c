"""Operators on literal rows: the expectations of the graph, resolution, delta and diagram parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumengraph.functions import display as V
from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.functions import text as T
from lumengraph.operators import delta, diagrams, graph, grep, resolve, rollup, search
from lumengraph.sources import board, files

NODES = "ord bigint, id string, path string, name string, kind string"
EDGES = "ord bigint, source string, target string, relation string, confidence double"


def nodes(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], NODES)


def edges(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], EDGES)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    tokens = lambda s: one(spark, T.tokens(F.lit(s)))
    assert tokens("getHTTPResponse XMLFile") == ["get", "httpresponse", "xmlfile"]
    assert tokens("a 1B") == ["1b"] and tokens("a_1B-c2D") == ["1b", "c2"]
    assert tokens("a ş") == ["ş"] and tokens("ΑΣ") == ["ασ"]
    assert one(spark, T.normalize(F.lit("İIıi Ş"))) == "iiii ş"
    assert one(spark, T.normalize(F.lit("مَرْحَبًا أإآ مدرسة مستشفى"))) == "مرحبا ااا مدرسه مستشفي"
    composed = search.tokenized(spark.createDataFrame([(1, "café Å"), (2, "plain")], "i bigint, t string"), "i", "t")
    assert {r.id: r.tokens for r in composed.collect()} == {1: ["café", "å"], 2: ["plain"]}


def test_lines_and_grep(spark):
    lines = lambda s: one(spark, T.lines(F.lit(s)))
    assert lines("") == [] and lines("a\n") == ["a"] and lines("a\r\n\nb\n\n") == ["a", "", "b", ""]
    docs = spark.createDataFrame([("f", "  One\ntwo ONE\n"), ("g", None)], "path string, text string")
    assert [tuple(r) for r in grep.grep(docs, "path", "text", "^ *one", True).collect()] == [("f", 1, "One")]
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(ValueError):
            grep.checked_pattern(bad)


def test_bm25_counts_repeated_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, ""), (4, None)], "i bigint, t string")
    once, twice = ({r.id: r.score for r in search.bm25(docs, "i", "t", q).collect()} for q in ("alpha", "alpha alpha"))
    assert set(once) == {1, 2} and once[2] > once[1] and all(abs(twice[k] - 2 * once[k]) < 1e-9 for k in once)
    assert search.bm25(docs, "i", "t", "gamma").count() == 0


def test_rank(spark):
    n = nodes(spark, [(x, "p", x, "Function") for x in "ABC"])
    e = edges(spark, [("A", "B", "Calls", 1.0), ("B", "C", "Calls", 1.0), ("C", "A", "Calls", 1.0), ("A", "gone", "Calls", 1.0)])
    for kernel in (10**6, 0):
        rows = graph.rank(n, e, [("A", 1.0)], 0.25, 30, kernel).orderBy(F.desc("score")).collect()
        assert [r.id for r in rows][0] == "A" and len(rows) == 3 and abs(sum(r.score for r in rows) - 1) < 1e-6
    assert graph.rank(n, e, []).count() == 0
    assert {round(r.score, 4) for r in graph.rank(n, e, [("nobody", 1.0)]).collect()} == {0.3333}


def test_rank_by_joins_equals_the_kernel(spark):
    import random

    rng = random.Random(7)
    n = nodes(spark, [(f"n{k}", "p", f"n{k}", "Function") for k in range(60)])
    e = edges(spark, [(f"n{rng.randrange(60)}", f"n{rng.randrange(50)}", "Calls", 1.0) for _ in range(150)])
    one, many = ({r.id: r.score for r in graph.rank(n, e, [("n1", 2.0), ("n2", 1.0)], 0.25, 8, size).collect()} for size in (10**6, 0))
    assert set(one) == set(many) and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_grep_anchors(spark):
    docs = spark.createDataFrame([(1, "a foo\nbar"), (2, "foo x")], "i bigint, t string")
    assert {(r.id, r.line_no) for r in grep.grep(docs, "i", "t", r"foo\z").collect()} == {(1, 1)}
    assert {(r.id, r.line_no) for r in grep.grep(docs, "i", "t", r"\A(foo|bar)").collect()} == {(1, 2), (2, 1)}


def test_paths_of_the_graph(spark):
    n = nodes(spark, [(x, "p", x, "File") for x in ("ui", "api", "db", "isolated")])
    e = edges(spark, [("ui", "api", "Calls", 1.0), ("api", "db", "Calls", 1.0), ("db", "ui", "Calls", 1.0)])
    assert graph.shortest_path(n, e, "ui", "db") == ["ui", "api", "db"] and graph.shortest_path(n, e, "ui", "ui") == ["ui"]
    assert graph.shortest_path(n, e, "ui", "isolated") is None and graph.shortest_path(n, e, "ui", "nobody") is None


RUST_DEFS = "id string, name string, file string, package string, owner string, is_pub boolean"


def test_rust_tiers(spark):
    defs = spark.createDataFrame([
        ("a:run", "run", "a", "P", None, True), ("a:S::save", "save", "a", "P", "S", True), ("a:S::path", "path", "a", "P", "S", True), ("b:calc", "calc", "b", "P", None, True),
        ("b:oku", "oku", "b", "P", None, True), ("c:oku", "oku", "c", "P", None, True), ("d:far", "far", "d", "Q", None, True), ("d:hid", "hid", "d", "Q", None, False), ("b:T::make", "make", "b", "P", "T", False),
    ], RUST_DEFS)
    calls = spark.createDataFrame([
        ("a:run", 0, "calc"), ("a:run", 1, ".save"), ("a:run", 2, ".path"), ("a:run", 3, "oku"), ("a:run", 4, "far"), ("a:run", 5, "hid"), ("a:run", 6, "T::make"), ("a:run", 7, "b::calc"), ("a:run", 8, "run"), ("a:run", 9, "Vec::new"),
    ], "caller string, tok_ord bigint, token string").withColumns({"file": F.lit("a"), "package": F.lit("P"), "owner": F.lit(None).cast("string")})
    imports = spark.createDataFrame([("a", "b")], "file string, other_file string")
    deps = spark.createDataFrame([("P", "Q")], "package string, other_package string")
    modules = spark.createDataFrame([("a", "b", "b")], "file string, qualifier string, other_file string")
    got = {(r.source, r.target): r.confidence for r in resolve.resolve_rust(calls, defs, imports, deps, modules).collect()}
    # `oku` is in scope once (b is imported), though the package has two.
    assert got == {("a:run", "b:calc"): 0.9, ("a:run", "a:S::save"): 0.7, ("a:run", "b:oku"): 0.9, ("a:run", "d:far"): 0.6, ("a:run", "b:T::make"): 0.85}


def test_packages_and_flow(spark):
    packages = spark.createDataFrame([("cli", "cli", "crates/cli"), ("core", "core", "crates/core")], "id string, name string, dir string")
    deps = spark.createDataFrame([("cli", "core", "crates/core", False, False, False), ("cli", "ext", "../other", False, True, False), ("cli", "t", "crates/core", False, True, True), ("cli", "reg", None, False, False, False), ("core", "cli", None, True, True, False)], "id string, name string, path_dir string, from_workspace boolean, optional boolean, dev boolean")
    shared = spark.createDataFrame([("", "cli", "crates/cli", "core")], "dir string, name string, path_dir string, owner string")
    got = {(r["from"], r.target_kind, r.to, r.weight) for r in resolve.package_links(packages, deps, shared).collect()}
    assert got == {("cli", "local", "core", 1.0), ("cli", "external", "ext:../other", 0.5), ("core", "local", "cli", 0.5)}
    fns = spark.createDataFrame([("r",), ("h",), ("n",)], "id string")
    io = spark.createDataFrame([("r", "r")], "id string, op string")
    names = spark.createDataFrame([("h", "x.db"), ("n", "y.db")], "id string, artifact string")
    calls = spark.createDataFrame([("r", "h")], "source string, target string")
    assert [tuple(r) for r in resolve.artifact_flow(fns, io, names, calls).collect()] == [("r", "artifact:x.db", "Reads", 0.9)]


def test_candidates_and_suffixes(spark):
    paths = spark.createDataFrame([("a/b.ts",), ("a/b/index.ts",), ("pkg/x/util.py",), ("other/util.py",)], "path string")
    wanted = spark.createDataFrame([(1,)], "id bigint")
    candidates = spark.createDataFrame([(1, 0, "a/b.js"), (1, 1, "a/b/index.ts"), (1, 2, "a/b.ts")], "id bigint, rank int, path string")
    assert [tuple(r) for r in resolve.ordered_candidates(wanted, candidates, paths).collect()] == [(1, "a/b/index.ts")]
    specs = spark.createDataFrame([(1, "x.util"), (2, "util"), (3, "none")], "id bigint, spec string")
    assert [tuple(r) for r in resolve.unique_suffix(specs, paths).collect()] == [(1, "pkg/x/util.py")]
    uses = resolve.use_counts(spark.createDataFrame([("p", "core_lib::a"), ("p", "core_lib::b"), ("p", "std::x")], "package string, spec string"), spark.createDataFrame([("p", "q", "core_lib"), ("p", "z", "zed")], "`from` string, `to` string, code_name string"))
    assert {(r["to"], r.uses) for r in uses.collect()} == {("q", 2), ("z", 0)}


def test_places_of_files(spark):
    rows = spark.createDataFrame([("ws/crates/core/src/db/mod.rs",), ("ws/crates/cli/src/main.rs",), ("ws/crates/core/tests/a.rs",), ("ws/src/x.rs",)], "path string")
    got = {r.path: r.x and tuple(r.x) for r in rows.select("path", P.locate(F.col("path"), F.lit(1), F.lit("ws")).alias("x")).collect()}
    assert got == {"ws/crates/core/src/db/mod.rs": ("core", "db"), "ws/crates/cli/src/main.rs": ("cli", "main"), "ws/crates/core/tests/a.rs": None, "ws/src/x.rs": ("ws", "x")}
    assert one(spark, P.join_norm(F.lit("a/b"), F.lit("../../../c/./d"))) == "c/d" and one(spark, P.module_name(F.lit("a/b/mod.rs"))) == "b"
    assert tuple(one(spark, P.rust_module(F.lit("c/src/a/b.rs")))) == ("c", "a::b") and tuple(one(spark, P.rust_module(F.lit("c/src/lib.rs")))) == ("c", "")
    pruned = spark.createDataFrame([("a/.git/x.rs",), ("a/.claude/x.rs",), ("a/x-out/y.rs",), ("docs/diyagramlar/a.rs",), ("src/build/a.rs",), ("src/a.rs",)], "path string")
    assert {r.path for r in pruned.where(~files.pruned(F.col("path")) & files.supported(F.col("path"))).collect()} == {"a/.claude/x.rs", "src/a.rs"}


def test_module_links_skip_ambiguous_names(spark):
    n = nodes(spark, [("file:w/crates/a/src/m.rs", "w/crates/a/src/m.rs", "m.rs", "File"), ("file:w/crates/b/src/n.rs", "w/crates/b/src/n.rs", "n.rs", "File"), ("f", "w/crates/a/src/m.rs", "f", "Function"), ("new1", "w/crates/a/src/m.rs", "new", "Function"), ("new2", "w/crates/b/src/n.rs", "new", "Function"), ("uniq", "w/crates/b/src/n.rs", "uniq", "Function")])
    e = edges(spark, [("f", "new2", "Calls", 1.0), ("f", "uniq", "Calls", 1.0), ("f", "uniq", "Calls", 1.0), ("f", "new2", "Reads", 1.0)])
    placed = rollup.modules_of(n)
    assert {r.key: (r.files, r.symbols) for r in rollup.modules(placed).collect()} == {"a/m": (1, 2), "b/n": (1, 2)}
    assert [tuple(r) for r in rollup.dependencies(placed, e).collect()] == [("a/m", "b/n", 3, "Calls")]


def test_delta_and_hashes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, role string")
    got = {tuple(r) for r in delta.components(frame([("a", "Backend"), ("b", "Database"), ("s", "x")]), frame([("a", "Cloud"), ("c", "Database"), ("s", "x")]), ["role"]).collect()}
    assert got == {("a", "Modified"), ("b", "Removed"), ("c", "Added"), ("s", "Unchanged")}
    link = lambda rows: spark.createDataFrame(rows, "`from` string, `to` string")
    assert {tuple(r) for r in delta.connections(link([("a", "b")]), link([("a", "c")])).collect()} == {("a", "b", "Removed"), ("a", "c", "Added")}
    raw = spark.createDataFrame([(b"",), (b"a",), (b"foobar",), ("ş".encode(),)], "content binary")
    assert [r.h & (2**64 - 1) for r in raw.select(delta.fnv1a().alias("h")).collect()][:3] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    rows = spark.createDataFrame([("a.rs",), ("a.rs2",)], "owner_path string")
    assert [r.owner_path for r in delta.forget(rows, spark.createDataFrame([("a.rs",)], "path string")).collect()] == ["a.rs2"]


def test_labels(spark):
    roles = [one(spark, L.role_for(F.lit(m), F.lit("core"))) for m in ("guide", "gui-kit", "auth", "build", "Güvenlik", "indeks")]
    assert roles == ["Backend", "Frontend", "Security", "Backend", "Security", "Database"]
    states = [one(spark, L.status_of(F.lit(w))) for w in (" DONE ", "KISMİ", "Todo", "wont_do", "soon")]
    assert states == ["done", "partial", "pending", "deferred", "unreadable"] and one(spark, L.status_of(F.lit(None).cast("string"))) == "unreadable"
    assert one(spark, L.role_for_package(F.lit("x"), F.array(F.lit("clap")), F.lit(False), F.lit(False))) == "Frontend"


def test_board(spark):
    rows = lambda *texts: spark.createDataFrame([(f"r{k}/.harness/{n}", t.encode()) for k, (n, t) in enumerate(texts)], "path string, content binary")
    done, mixed = json.dumps({"features": [{"id": "1", "name": "a", "status": "done"}]}), json.dumps({"sema": "other/9", "hedefler": [{"durum": "tamam", "title": " "}, 7, {"status": 3, "durum": "?"}]})
    goals = board.goals(rows((board.NEW_FILE, done), (board.NEW_FILE, mixed), (board.NEW_FILE, '{"features": []}')))
    got = {r.path[:2]: r for r in board.summary(goals, "goals/1").collect()}
    assert got["r0"].green and not got["r1"].green and (got["r1"].goals, got["r1"].done, got["r1"].unreadable, got["r1"].schema_valid) == (3, 1, 2, False)
    assert not got["r2"].green and got["r2"].goals == 0
    both = spark.createDataFrame([("r/.harness/feature-list.json", b"old"), ("r/.harness/hedefler.json", b"broken")], "path string, content binary")
    assert board.preferred(both).first().content == b"broken"
    with pytest.raises(board.BoardError):
        board.parse("x", "{")


def test_layers_and_messages():
    assert diagrams.layers(3, [(0, 1), (1, 2)]) == [0, 1, 2] and diagrams.layers(3, [(0, 2), (0, 1), (1, 2)]) == [0, 1, 2]
    assert sorted(diagrams.layers(2, [(0, 1), (1, 0)])) == [0, 1]


def test_sequence_and_dataflow(spark):
    n = nodes(spark, [("a:main", "a.rs", "main", "Function"), ("b:main", "main.rs", "main", "Function"), ("authenticate", "c.rs", "authenticate", "Function"), ("query", "c.rs", "query", "Function")])
    e = edges(spark, [("b:main", "authenticate", "Calls", 1.0), ("b:main", "query", "Calls", 1.0), ("a:main", "query", "Writes", 1.0), ("query", "artifact:x", "Writes", 1.0), ("authenticate", "artifact:x", "Reads", 1.0)])
    record = diagrams.sequence(n, e, "main")
    assert [p["id"] for p in record["participants"]] == ["b:main", "authenticate", "query"] and [m["to"] for m in record["messages"]] == ["authenticate", "query"]
    assert diagrams.sequence(n, e, "nobody")["messages"] == [] and diagrams.sequence_svg(record).count("<line") == 5
    flow = diagrams.dataflow(e.where("target = 'artifact:x'"))
    assert len(flow["nodes"]) == 3 and len(flow["pipelines"]) == 2


def test_display(spark):
    assert V.encode_wiring(1, 2, 3, ["rust"]) == b"\x01\x02\x03\x01\x04rust" and V.decode_wiring(b"\x01\x02\x03\x01\x04rust") == (1, 2, 3, ["rust"])
    for n in (0, 250, 251, 65_535, 65_536, 2**32, 2**64 - 1):
        assert V.read_varint(V.varint(n), 0) == (n, len(V.varint(n)))
    assert V.decode_wiring(b"\x01\x02\x03\x01\x04rus") is None and V.decode_wiring(b"\x01\x02\x03\x00\x00") is None and V.decode_wiring(b"\xff") is None
    assert V.units("a漢́") == 3 and V.truncate("abcdefghij", 5) == "abcd…" and V.truncate("averylongfilename.rs", 12).endswith(".rs")
    assert V.fit("ab", 100, 12, 8) == ("ab", 12, False) and V.fit("x" * 40, 60, 12, 8)[2]
    assert one(spark, V.escaped(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;" and one(spark, V.shortened(F.lit("abcdef"), 4)) == "abc…"
    assert [one(spark, V.number(F.lit(x))) for x in (1.0, 2.25, -0.01, 10.0, 0.5)] == ["1", "2.3", "0", "10", "0.5"] or one(spark, V.number(F.lit(10.0))) == "10"


def test_callers_of_data_users(spark):
    calls = [("x", "u"), ("y", "u"), ("x", "v"), ("y", "v"), ("w", "v"), ("same", "w"), ("u", "v"), ("z", "w")]
    e = spark.createDataFrame([(k, a, b, "Calls", 0.9) for k, (a, b) in enumerate(calls)] + [(50 + k, a, "artifact:f", r, 0.9) for k, (a, r) in enumerate([("u", "Writes"), ("v", "Reads"), ("w", "Reads")])], "ord bigint, source string, target string, relation string, confidence double")
    own = spark.createDataFrame([("u", "p"), ("v", "p"), ("w", "q"), ("x", "r"), ("y", "r"), ("same", "q"), ("z", None)], "id string, package string")
    made = diagrams.dataflow(e, packages=own)
    assert [(p["from"], p["to"]) for p in made["pipelines"] if p["kind"] == "call"] == [("x", "u"), ("y", "v"), ("z", "w")]
    assert {n["id"] for n in made["nodes"]} == {"artifact:f", "u", "v", "w", "x", "y", "z"}
    assert diagrams.entry_calls(e, ["u", "v", "w"], own, 1) == [("x", "u")] and diagrams.entry_calls(e, ["u", "v", "w"], own, 0) == []
    assert not [p for p in diagrams.dataflow(e)["pipelines"] if p["kind"] == "call"]


def test_rank_by_joins_holds_only_what_leads_on(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"n{k}" for k in range(60)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "n3"]], "id string")
    # Two thirds of the nodes are ends of ways; some edges are repeated, loops, or lead to what is no node.
    links = [(rng.choice(names[:20]), rng.choice([*names, "gone"])) for _ in range(150)] + [("n1", "n2")] * 3 + [("n5", "n5"), ("gone", "n1")]
    edges = spark.createDataFrame(links, "source string, target string")
    held = []
    real = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, name="table": held.append((name, out := real(df, name))) or out)
    for seeds in ([("n1", 1.0), ("n30", 0.5), ("gone", 2.0)], [("gone", 1.0)]):
        for rounds in (0, 1, 7):
            held.clear()
            got, want = ({r.id: round(r.score, 9) for r in graph.rank(nodes, edges, seeds, 0.25, rounds, kernel).collect()} for kernel in (0, 1000))
            assert got == want and want
    ranks = [df.count() for name, df in held if name == "rank"]
    assert len(ranks) == 7 and max(ranks[:-1]) <= 20 and ranks[-1] == 60


def test_data_flow_meets_its_edges_once(spark):
    links = [(k, f"u{k % 4}", f"artifact:{k % 3}", "Writes" if k % 5 == 0 else "Reads") for k in range(40)] + [(41, "u9", "artifact:0", "Reads")]
    edges = spark.createDataFrame(links, "ord bigint, source string, target string, relation string")
    met = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            met.add(part.num_rows)
            yield part

    record = diagrams.dataflow(edges.mapInArrow(count, edges.schema), 2)
    assert met.value == len(links)
    assert record["hidden"] == {"artifact:0": 1, "artifact:1": 0} and len({n["id"] for n in record["nodes"]}) == 6
    assert len(record["pipelines"]) == len({(t, s, r) for _, s, t, r in links if t != "artifact:2" and s != "u9"})


def test_no_task_gets_all_calls_of_a_file(spark):
    """A tier that goes through pairs looks each name and file up once; calls are never dealt by their file alone."""
    import re

    from lumengraph.operators import resolve

    calls = spark.createDataFrame([(f"c{k}", k, "f", "a.rs", "p") for k in range(20)] + [("c", 99, "g", "a.rs", None), ("c", 100, None, "a.rs", "p")], "caller string, tok_ord long, name string, file string, package string")
    defs = spark.createDataFrame([("b.rs:f", "f", "b.rs", "p", True), ("b.rs:g", "g", "b.rs", None, True), ("d.rs:g", "g", "d.rs", None, True)], "id string, name string, file string, package string, is_pub boolean")
    imports = spark.createDataFrame([("a.rs", "b.rs")], "file string, other_file string")
    deps = spark.createDataFrame([], "package string, other_package string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolve.resolve(calls, defs, resolve.free_function_rules(imports, deps, defs))
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        rows = sorted((r.caller, r.tok_ord, r.target, r.confidence) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert rows == sorted([(f"c{k}", k, "b.rs:f", 0.9) for k in range(20)] + [("c", 99, "b.rs:g", 0.9)])
    dealt = [b for b in plan.split("\n\n") if ") Exchange" in b and "caller#" in b]
    assert dealt and not [b for b in dealt if re.search(r"hashpartitioning\(file#\w+, \d+\)", b)]
