"""Call sequences, first shortest paths, module paths and linear-time search against brute force."""

import random
import re
import time
from collections import deque

import pytest

from lumengraph import engine
from lumengraph.operators import graph, grep, resolve, sequence


def walked(root, calls, depth, most):
    """Messages by a walk with a stack: each function is opened where it comes up first."""
    out, opened, waiting = [], set(), [(root, 0)]
    while waiting:
        caller, at = waiting.pop()
        if at < depth and caller not in opened:
            opened.add(caller)
            shown = calls.get(caller, [])[: most - len(out)]
            out += [(caller, callee) for callee in shown]
            waiting += [(callee, at + 1) for callee in reversed(shown)]
    return out


@pytest.mark.parametrize(("depth", "most"), [(3, 30), (2, 7), (4, 12)])
def test_sequences_equal_a_walk(spark, depth, most):
    rng = random.Random(depth)
    names = [f"f{k}" for k in range(14)]
    rows, calls = [], {}
    for k, name in enumerate(names):
        for j, other in enumerate(rng.sample(names, rng.randrange(5))):  # cycles and calls of oneself among them
            rows.append((name, other, 100 * k + j))
            calls.setdefault(name, []).append(other)
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "source string, target string, ord bigint")
    known = spark.createDataFrame([(n,) for n in names if n != "f3"], "id string")
    roots = spark.createDataFrame([(n,) for n in [*names, "f0", "nobody"]], "id string")
    got = {}
    for r in sequence.messages(edges, roots, known, depth, most).orderBy("root", "place").collect():
        got.setdefault(r.root, []).append((r.source, r.target))
    held = {s: [t for t in ts if t != "f3"] for s, ts in calls.items()}
    want = {n: walked(n, held, depth, most) for n in names}
    assert got == {n: m for n, m in want.items() if m}
    assert any(len(m) == most for m in want.values()) or most == 30


def test_first_paths_equal_a_search(spark):
    rng = random.Random(7)
    nodes = [f"n{k}" for k in range(30)]
    rows = [(rng.choice(nodes), rng.choice(nodes), k) for k in rng.sample(range(1000), 70)]
    rows += [rows[0], (rows[1][0], rows[1][1], 2000)]  # repeated and parallel edges
    prev, queue = {"n0": None}, deque(["n0"])
    while queue:
        at = queue.popleft()
        for s, t, _ in sorted(rows, key=lambda r: (r[2], r[1])):
            if s == at and t not in prev:
                prev[t] = at
                queue.append(t)

    def path(n):
        return [*path(prev[n]), n] if prev[n] else [n]

    edges = spark.createDataFrame(rows, "source string, target string, ord bigint")
    got = {r.id: (r.hops, r.path) for r in graph.first_paths(edges, "n0").collect()}
    assert got == {n: (len(path(n)) - 1, path(n)) for n in prev}
    frame = spark.createDataFrame([(n,) for n in nodes], "id string")
    far = max(prev, key=lambda n: len(path(n)))
    assert graph.shortest_path(frame, edges, "n0", far) == path(far) and graph.shortest_path(frame, edges, "n0", "n0") == ["n0"]
    assert graph.shortest_path(frame, edges, "n0", "none") is None
    lost = [n for n in nodes if n not in prev]
    assert not lost or graph.shortest_path(frame, edges, "n0", lost[0]) is None


def test_module_paths_of_calls(spark):
    files = ["src/lib.rs", "src/a/mod.rs", "src/a/b.rs", "src/c.rs"]
    nodes = spark.createDataFrame([(f, "File") for f in files], "path string, kind string")
    defs = [("lib:f", "f", "src/lib.rs"), ("a:f", "f", "src/a/mod.rs"), ("b:f", "f", "src/a/b.rs"), ("c:f", "f", "src/c.rs"), ("c:main", "main", "src/c.rs")]
    shape = "id string, name string, file string, package string, owner string, is_pub boolean"
    fns = spark.createDataFrame([(i, n, f, "p", None, True) for i, n, f in defs] + [("c:T::collect", "collect", "src/c.rs", "p", "T", True), ("b:T::m", "m", "src/a/b.rs", "p", "T", True)], shape)
    tokens = {"crate::a::b::f": "b:f", "super::a::f": "a:f", "self::gone::f": "c:f", "b::f": "b:f", "crate::f": "lib:f", "zz::f": None, ".collect": None, "T::m": "b:T::m", "f": "c:f"}
    empty = spark.createDataFrame([], "package string, other_package string")
    imports = spark.createDataFrame([("src/c.rs", "src/a/b.rs")], "file string, other_file string")
    crates = spark.createDataFrame([], "id string, dir string, code_name string")
    for token, target in tokens.items():
        calls = spark.createDataFrame([("c:main", 0, token, "src/c.rs", "p", None)], "caller string, tok_ord bigint, token string, file string, package string, owner string")
        wanted = resolve.qualifiers(calls)
        led = engine.module_paths(wanted.selectExpr("file", "qualifier AS spec"), nodes, crates)
        modules = resolve.module_files(wanted, led, imports.selectExpr("file", "regexp_extract(other_file, '([^/]*)[.]rs$', 1) AS module", "other_file"))
        assert [r.target for r in resolve.resolve_rust(calls, fns, imports, empty, modules).collect()] == ([target] if target else []), token


def test_search_is_linear(spark):
    docs = spark.createDataFrame([(1, "a" * 100_000 + "!"), (2, "aaa"), (3, None)], "id bigint, text string")
    began = time.time()
    assert [r.id for r in grep.grep(docs, "id", "text", "(a+)+$").collect()] == [2]
    assert time.time() - began < 30


@pytest.mark.parametrize(("pattern", "fold"), [(r"\bopen(ed)? the\b", True), (r"stor(e|age)", False), (r"x+y", False), (r"^fn\s+\w+", False), (r"ünder", True), (r"Kelvin|open", True), (r"[a-z]+_[0-9]+", False), (r"kiss", True)])
def test_search_equals_a_scan(spark, pattern, fold):
    rng = random.Random(3)
    words = ["Open", "the", "opened", "store", "storage", "xxy", "fn", "go_12", "Ünder", "ünder", "Kelvin", "K", "kiſs", "KISS", "a"]
    texts = {k: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\r\n"]) for _ in range(rng.randrange(30))) for k in range(120)}
    docs = spark.createDataFrame([*texts.items(), (None, "open the"), (500, None), (501, "")], "id bigint, text string")
    plain = {(k, n, line.strip(" ")) for k, text in texts.items() for n, line in enumerate(re.sub(r"\r?\n\Z", "", text).split("\n") if text else [], 1) if re.search(pattern, line.rstrip("\r"), re.IGNORECASE if fold else 0)}
    rows = {(r.id, r.line_no, r.line) for r in grep.grep(docs, "id", "text", pattern, fold).where("id IS NOT NULL").collect()}
    assert rows == {(k, n, line.rstrip("\r").strip(" ")) for k, n, line in plain}
    index = grep.trigrams(docs, "id", "text")
    assert {(r.id, r.line_no, r.line) for r in grep.grep_indexed(docs, index, "id", "text", pattern, fold).where("id IS NOT NULL").collect()} == rows


def test_literals_of_patterns():
    assert grep.literals(r"ab(c|d)ef+gh(ij)k?lmn") == ["ab", "e", "f", "ghij", "lmn"]
    assert grep.literals("abc|def") == [] and grep.literals("(?i)abc") == [] and grep.literals(r"\p{L}abc") == []
    assert grep.literals("OPEN") == ["OPEN"] and grep.literals("OPEN s", True) == ["open "]
    for bad in ("(?=a)", r"(a)\1", "(", "a**"):
        with pytest.raises(ValueError):
            grep.checked_pattern(bad)
