"""Import files and binding tiers of the other languages."""

from lumengraph.operators import imports as I


def test_files_of_specs(spark):
    files = spark.createDataFrame([("w/a/m.ts",), ("w/a/m/index.ts",), ("w/n/index.js",), ("p/__init__.py",), ("p/q/util.py",), ("p/base.py",), ("z/util.py",)], "path string")
    js = I.script_imports(spark.createDataFrame([("w/a/x.ts", "./m"), ("w/a/x.ts", "../n"), ("w/a/x.ts", "react"), ("w/a/x.ts", "./none")], "file string, spec string"), files)
    assert {tuple(r) for r in js.collect()} == {("w/a/x.ts", "./m", "w/a/m.ts"), ("w/a/x.ts", "../n", "w/n/index.js")}
    py = I.python_imports(spark.createDataFrame([("p/q/a.py", ".util"), ("p/q/a.py", "..base"), ("p/q/a.py", ".."), ("p/q/a.py", "q.util"), ("p/q/a.py", "util")], "file string, spec string"), files)
    assert {(r.spec, r.other_file) for r in py.collect()} == {(".util", "p/q/util.py"), ("..base", "p/base.py"), ("..", "p/__init__.py"), ("q.util", "p/q/util.py")}


def test_binding_tiers(spark):
    defs = spark.createDataFrame([
        ("m:K", "K", "Class", "m", "d", None, True), ("m:K::constructor", "constructor", "Method", "m", "d", "K", True), ("m:make", "make", "Function", "m", "d", None, True),
        ("x:K2::load_all", "load_all", "Method", "x", "d", "K2", True), ("x:local", "local", "Function", "x", "d", None, True), ("y:other", "other", "Function", "y", "d", None, True),
    ], "id string, name string, kind string, file string, dir string, owner string, is_pub boolean")
    tokens = ["new:K", "ns.make", "local", "other", "mk", "~load_all", "ext.load_all", "json.load_all", "ext"]
    calls = spark.createDataFrame([("x:run", k, t, "x", "d", "js", None) for k, t in enumerate(tokens)], "caller string, tok_ord bigint, token string, file string, dir string, lang string, owner string")
    facts = spark.createDataFrame([("x", "ns|*|./m"), ("x", "mk|make|./m"), ("x", "ext|*|outside")], "file string, value string")
    imports = spark.createDataFrame([("x", "./m", "m")], "file string, spec string, other_file string")
    bound, external = I.bindings(facts, imports)
    got = {(r.target, r.confidence) for r in I.resolve_other(calls, defs, imports, bound, external).collect()}
    assert got == {("m:K::constructor", 0.85), ("m:make", 0.9), ("x:local", 0.95), ("x:K2::load_all", 0.7)}
    go = I.resolve_other(calls.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("go")), defs, imports, bound, external)
    assert ("y:other", 0.75) in {(r.target, r.confidence) for r in go.collect()}
