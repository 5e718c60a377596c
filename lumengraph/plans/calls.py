"""Queries for call sequences and module paths over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph import engine
from lumengraph.functions import paths as P
from lumengraph.operators import graph, grep, resolve, sequence
from lumengraph.plans import resolution
from lumengraph.plans.text_search import _LINES
from lumengraph.runtime import durable, table
from lumengraph.sources import driver_graph as D

START = "file:crates/r0/src/n0.rs"
PATTERN = r"(licen[cs]ed|released)? ?under +the +[a-z]\w+"


def call_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every file's busiest function the calls in reading order, three deep, thirty at most."""
    g = D.load(spark, sf_dir)
    calls = g.edges.where("relation = 'Calls'")
    busy = calls.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    roots = g.nodes.where("kind = 'Function'").join(busy, "id").groupBy("path").agg(F.max_by("id", F.struct("n", "ord")).alias("id"))
    return sequence.messages(calls, roots, g.nodes)


def module_path_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`crate::n3::f`, `super::n3::f`, `self::n3::f`, `r2::n3::f`, `r2::gone::f` and `n3::f`, each met in its file.

    Every package has a root file beside its modules; what a path leads to is looked up before the
    modules that a file imports.
    """
    fns = resolution._functions(spark, sf_dir).withColumn("owner", F.lit(None).cast("string"))
    # Every fourth function stands in its package's root file.
    home = F.when(F.col("ord") % 4 == 0, F.concat("package", F.lit("/src/lib.rs"))).otherwise(F.col("file"))
    fns = fns.withColumns({"file": home, "name": F.concat(F.lit("fn_"), (F.col("ord") - 10_000) % 350)})
    region = table(spark, sf_dir, "region")
    roots = region.select(F.concat(F.lit("crates/r"), "r_regionkey", F.lit("/src/lib.rs")).alias("path"))
    nodes = D.load(spark, sf_dir).nodes.where("kind = 'File'").select("path").union(roots).withColumn("kind", F.lit("File"))
    packages = region.select(F.concat(F.lit("crates/r"), "r_regionkey").alias("dir"), F.lit(None).cast("string").alias("code_name"))
    k = F.col("o_orderkey")
    module, package = F.concat(F.lit("n"), k % 25), F.concat(F.lit("r"), k % 5)
    path = F.array(*[F.concat_ws("::", *x) for x in ((F.lit("crate"), module), (F.lit("super"), module), (F.lit("self"), module), (package, module), (package, F.lit("gone")), (module,))])
    token = F.concat_ws("::", F.get(path, (k % 6).cast("int")), F.concat(F.lit("fn_"), k % 350))
    own = fns.select("ord", F.col("id").alias("caller"), "file", "package", "owner")
    calls = table(spark, sf_dir, "orders").join(own, F.col("o_custkey") + 10_000 == F.col("ord")).select("caller", k.alias("tok_ord"), token.alias("token"), "file", "package", "owner")
    imports = resolution._imports(spark, sf_dir)
    wanted = resolve.qualifiers(calls)
    led = engine.module_paths(wanted.select("file", F.col("qualifier").alias("spec")), nodes, packages)
    modules = resolve.module_files(wanted, led, imports.select("file", P.module_name(F.col("other_file")).alias("module"), "other_file"))
    return resolve.resolve_rust(calls, fns, imports, resolution._package_deps(spark, sf_dir), modules)


def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole shortest paths over imports and what files hold, up to six steps from one file; of equal ones the first by edges."""
    edges = D.load(spark, sf_dir).edges.where("relation IN ('Imports', 'Contains')")
    return graph.first_paths(edges, START, most_hops=6).select("id", "hops", F.array_join("path", " > ").alias("path"))


def grep_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: matching lines by way of an index of trigrams, whole patterns in RE2."""
    docs = table(spark, sf_dir, "documents")
    index = durable(grep.trigrams(docs, "doc_id", "text"), "trigrams")
    return grep.grep_indexed(docs, index, "doc_id", "text", PATTERN, True).select(F.col("id").alias("doc_id"), "line_no", "line")


QUERIES = {f.__name__: f for f in (call_sequences, module_path_calls, first_paths, grep_trigrams)}
ORACLES = {
    "first_paths": f"""
WITH RECURSIVE {D.SQL},
walk AS (
  SELECT '{START}' AS id, 0 AS hops, ['{START}'] AS path, []::STRUCT(ord BIGINT, target VARCHAR)[] AS steps
  UNION ALL SELECT target, hops + 1, path || [target], steps || [{{'ord': ord, 'target': target}}] FROM walk JOIN edges ON source = id WHERE relation IN ('Imports', 'Contains') AND hops < 6)
SELECT id, min(hops)::INTEGER AS hops, array_to_string(arg_min(path, struct_pack(h := hops, s := steps)), ' > ') AS path FROM walk GROUP BY id""",
    "grep_trigrams": f"SELECT doc_id, n AS line_no, trim(l[n]) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(n) WHERE regexp_matches(l[n], '(?i){PATTERN}')",
    "call_sequences": f"""
WITH RECURSIVE {D.SQL},
calls AS MATERIALIZED (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY ord, target) AS k, count(*) OVER (PARTITION BY source) AS n FROM edges WHERE relation = 'Calls' AND target IN (SELECT id FROM nodes)),
listed AS MATERIALIZED (SELECT source, list(target ORDER BY k) AS callees FROM calls WHERE k <= 30 GROUP BY source),
roots AS (SELECT arg_max(id, struct_pack(n := n, ord := ord)) AS id FROM nodes JOIN (SELECT DISTINCT source, n FROM calls) ON source = id WHERE kind = 'Function' GROUP BY path),
walk AS (
  SELECT id AS root, [{{'id': id, 'd': 0}}] AS stack, []::VARCHAR[] AS done, []::STRUCT(a VARCHAR, b VARCHAR)[] AS said FROM roots
  UNION ALL
  SELECT root, stack[1:len(stack) - 1] || list_reverse(list_transform(taken, lambda x: {{'id': x, 'd': top.d + 1}})), CASE WHEN opens THEN list_append(done, top.id) ELSE done END, said || list_transform(taken, lambda x: {{'a': top.id, 'b': x}})
  FROM (SELECT *, CASE WHEN opens THEN coalesce(callees, []::VARCHAR[])[1:30 - len(said)] ELSE []::VARCHAR[] END AS taken
        FROM (SELECT w.*, top.d < 3 AND NOT list_contains(done, top.id) AS opens, l.callees FROM (SELECT *, stack[len(stack)] AS top FROM walk WHERE len(stack) > 0) w LEFT JOIN listed l ON l.source = top.id))),
ended AS (SELECT root, unnest(said) AS x, unnest(range(1, len(said) + 1)) AS place FROM walk WHERE len(stack) = 0)
SELECT root, place::BIGINT AS place, x.a AS source, x.b AS target FROM ended""",
    "module_path_calls": f"""
WITH {D.SQL},
fn AS (SELECT id, CASE WHEN (c_custkey + 10000) % 4 = 0 THEN package || '/src/lib.rs' ELSE path END AS file, 'fn_' || (c_custkey % 350) AS name, package, c_custkey FROM (SELECT *, regexp_extract(path, '^(crates/r[0-9]+)/', 1) AS package FROM fns)),
one AS (SELECT file, name, min(id) AS target FROM fn GROUP BY ALL HAVING count(*) = 1),
files2 AS (SELECT path FROM files UNION ALL SELECT 'crates/r' || r_regionkey || '/src/lib.rs' FROM region),
imp AS (SELECT source[6:] AS file, target[6:] AS other FROM edges WHERE relation = 'Imports'),
cl AS (SELECT f.id AS caller, f.file, f.package, o_orderkey AS k FROM orders JOIN fn f ON o_custkey = f.c_custkey),
-- Where a path begins, and the module below it, if it names one.
placed AS (SELECT *, CASE WHEN k % 6 IN (3, 4) THEN 'crates/r' || (k % 5) ELSE package END AS root, CASE WHEN k % 6 = 4 THEN 'gone' ELSE 'n' || (k % 25) END AS module FROM cl),
led AS (
  SELECT *, CASE
    WHEN k % 6 = 5 THEN (SELECT min(other) FROM imp WHERE imp.file = placed.file AND imp.other LIKE '%/' || module || '.rs')
    WHEN k % 6 = 2 AND placed.file NOT LIKE '%/lib.rs' THEN placed.file
    WHEN EXISTS (SELECT 1 FROM files2 WHERE path = root || '/src/' || module || '.rs') THEN root || '/src/' || module || '.rs'
    ELSE root || '/src/lib.rs' END AS other FROM placed)
SELECT caller AS source, target, 0.95::DOUBLE AS confidence, min(k) AS tok_ord FROM led JOIN one ON one.file = led.other AND one.name = 'fn_' || (k % 350) WHERE caller <> target GROUP BY ALL""",
}
