"""Queries over a workspace of packages made of the driver's suppliers: dependencies, roll-ups, cuts, pictures' geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.operators import diagrams, grep, packages, tours
from lumengraph.operators import graph as G
from lumengraph.runtime import table
from lumengraph.sources import driver_graph as D

K = "s_suppkey"
TOP = 9


def _dir() -> Column:
    return F.concat(F.lit("ws"), F.col(K) % 5, F.lit("/p"), F.col(K))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines: five workspaces, a package per supplier, seven kinds of dependencies."""
    rows = table(spark, sf_dir, "supplier").select(K)
    two = (F.col(K) * 3) % 7 + 1
    line = lambda *parts: F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    own = rows.select(F.concat(F.lit("file:"), _dir(), F.lit("/Cargo.toml")).alias("file_id"), F.posexplode(F.array(
        line("cargo:package", F.concat(F.lit("p-"), F.col(K)), "0", "", "0", ""),
        line("cargo:dep", F.concat(F.lit("p-"), two), "0", F.when(F.col(K) % 4 == 0, "1").otherwise("0"), "0", F.concat(F.lit("../../ws"), two % 5, F.lit("/p"), two)),
        line("cargo:dep", F.concat(F.lit("p-"), F.col(K) + 5), "1", "0", "0", ""),
        line("cargo:dep", "zzz", "1", "0", "0", ""),
        line("cargo:dep", F.concat(F.lit("ext-"), F.col(K) % 7), "0", "1", "0", F.concat(F.lit("../../../far/lib"), F.col(K) % 7)),
        line("cargo:dep", F.concat(F.lit("p-"), two), "0", "0", "1", "../other"),
        line("cargo:dep", F.when(F.col(K) % 11 == 0, "clap").otherwise("serde"), "0", "0", "0", ""),
        line("cargo:dep", "self", "0", "0", "0", "."),
    )).alias("pos", "spec"))
    top = rows.select(F.concat(F.lit("file:ws"), F.col(K) % 5, F.lit("/Cargo.toml")).alias("file_id"), (F.col(K) + 1).cast("int").alias("pos"), line("cargo:shared", F.concat(F.lit("p-"), F.col(K)), "", "", "", F.concat(F.lit("p"), F.col(K))).alias("spec"))
    heads = rows.select(F.concat(F.lit("file:ws"), F.col(K) % 5, F.lit("/Cargo.toml")).alias("file_id"), F.lit(0).alias("pos"), F.lit("cargo:package||0||1|").alias("spec")).distinct()
    return own.union(top).union(heads)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, imports and facts of the packages' files."""
    rows = table(spark, sf_dir, "supplier").select(K)
    kept = lambda by, path: F.when(F.col(K) % by == 0, F.concat(_dir(), F.lit(path)))
    files = rows.select(K, F.explode(F.array(F.concat(_dir(), F.lit("/Cargo.toml")), F.concat(_dir(), F.lit("/tests/t.rs")), kept(2, "/src/lib.rs"), kept(3, "/src/main.rs"), kept(5, "/src/bin/x.rs"))).alias("path")).where("path IS NOT NULL")
    file_id = F.concat(F.lit("file:"), "path")
    shape = lambda df, i, path, name, kind: df.select(i.alias("id"), path.alias("path"), name.alias("name"), F.lit(kind).alias("kind"))
    manifest = F.concat(_dir(), F.lit("/Cargo.toml"))
    name = F.concat(F.lit("p-"), F.col(K))
    fn = files.where(F.col("path").endswith(".rs"))
    nodes = shape(files, file_id, F.col("path"), P.file_name(F.col("path")), "File").union(shape(rows, F.concat(manifest, F.lit(":"), name), manifest, name, "Crate"))
    nodes = nodes.union(shape(fn, F.concat("path", F.lit(":f")), F.col("path"), F.concat(F.lit("f"), F.col(K) % 3), "Function"))
    lib = files.where(F.col("path").endswith("/src/lib.rs"))
    facts = fn.select(file_id.alias("node_id"), F.lit(0).alias("pos"), F.lit("loc").alias("tag"), (F.col(K) * 7).cast("string").alias("value"))
    facts = facts.union(lib.select(F.concat("path", F.lit(":f")), F.lit(0), F.lit("pub"), F.lit(None).cast("string")))
    two = (F.col(K) * 3) % 7 + 1
    paths = fn.select(file_id.alias("file_id"), F.posexplode(F.array(F.concat(F.lit("rs:p_"), two, F.lit("::a::b")), F.concat(F.lit("rs:p_"), two), F.concat(F.lit("rs:ext_"), F.col(K) % 7, F.lit("::x")), F.lit("rs:std::fs"))).alias("pos", "spec"))
    caller, callee = lib.select(K, F.concat("path", F.lit(":f")).alias("source")), lib.select(F.col(K).alias("k2"), F.concat("path", F.lit(":f")).alias("target"))
    edges = caller.join(callee, F.col("k2") == (F.col(K) % 8) + 2).select("source", "target", F.lit("Calls").alias("relation"))
    return nodes, edges, _lines(spark, sf_dir).union(paths.select("file_id", "pos", "spec")), facts


def nearest_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    return packages.homes(packages.specs(_lines(spark, sf_dir)))


def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per pair."""
    nodes, _, imports, _ = _tree(spark, sf_dir)
    return packages.depends_on(nodes, imports)[0].select("source", "target", "confidence")


def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of packages outside the tree."""
    nodes, _, imports, _ = _tree(spark, sf_dir)
    return packages.depends_on(nodes, imports)[1].select("id", "path", "name", F.col("search_body").alias("repo"))


def package_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with their lines, targets and roles."""
    boxes = packages.summary(*_tree(spark, sf_dir))[0]
    return boxes.select("id", F.col("box").alias("home"), "external", "lines", "bin", "lib", "role", F.concat_ws(",", "api").alias("api"))


def package_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    return packages.summary(*_tree(spark, sf_dir))[1]


def topk_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    return packages.top_boxes(*packages.summary(*_tree(spark, sf_dir)), TOP)


def package_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the record is cut; components by role, links by style."""
    record = diagrams.package_level(*packages.summary(*_tree(spark, sf_dir)), "tables")
    rows = [("component", c["role"]) for c in record["components"]] + [("link", x["line_style"] or "plain") for x in record["connections"]] + [("region", "") for _ in record["regions"]]
    return spark.createDataFrame(rows, "what string, name string").groupBy("what", "name").agg(F.count("*").alias("n")).where("what <> 'link'")


def story_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each step of a story is tied to the one before."""
    orders = table(spark, sf_dir, "orders")
    steps = orders.where("o_orderkey % 50 < 4").select((F.col("o_orderkey") / 50).cast("bigint").alias("beat"), F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 20).cast("string").alias("node"))
    links = orders.where("o_orderkey % 50 >= 40").select((F.col("o_custkey") % 20).cast("string").alias("from"), (F.col("o_orderkey") % 20).cast("string").alias("to"))
    return tours.story_steps(steps, links)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("x"), (F.col("p_size") * 2).alias("y"), (F.col("p_partkey") % 7 + 1).alias("width"), F.lit(5).alias("height"), F.col("p_size").alias("layer"))


def picture_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes per layer."""
    return diagrams.extent(_boxes(spark, sf_dir), "layer")


def smallest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest frame that holds a point."""
    frames = spark.createDataFrame([("all", 0, 0, 200, 200), ("left", 0, 0, 50, 200), ("mid", 40, 20, 20, 30), ("far", 500, 500, 1, 1)], "id string, x int, y int, width int, height int")
    return diagrams.smallest_region(_boxes(spark, sf_dir), frames)


def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    style = F.element_at(F.array(*[F.lit(x) for x in ("Strong", "emphasis", "SECURITY", "async", "dashed", "dotted", "animated", "", "other")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", L.edge_kind(style).alias("kind"))


def focus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among chosen nodes."""
    g = D.load(spark, sf_dir)
    return G.focus(g.edges, g.nodes.where("kind IN ('File', 'Crate')")).select("source", "target", "relation")


def adjacent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node and its neighbours."""
    return G.adjacent(D.load(spark, sf_dir).edges, "file:crates/r0/src/n0.rs")


def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    return G.node(D.load(spark, sf_dir).nodes, "file:crates/r1/src/n1.rs").select("id", "name", "kind")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: symbols whose declaration matches, with references."""
    g = D.load(spark, sf_dir)
    return grep.declarations(g.nodes.withColumn("search_body", F.concat(F.lit("fn "), "name")), g.edges, "^FN FN_1.$", True).select("name", "kind", "path", "refs", "ord")


_S = f"""s AS (SELECT s_suppkey AS k, 'ws' || (s_suppkey % 5) || '/p' || s_suppkey AS dir, 'ws' || (s_suppkey % 5) || '/p' || s_suppkey || '/Cargo.toml' AS path, 'p-' || s_suppkey AS name FROM supplier),
lk AS (SELECT a.path AS "from", b.path AS "to", a.k % 4 = 0 AS optional FROM s a JOIN s b ON b.k = (a.k * 3) % 7 + 1 AND a.k <> b.k
       UNION ALL SELECT a.path, b.path, false FROM s a JOIN s b ON b.k = a.k + 5
       UNION ALL SELECT path, 'ext:far/ext-' || (k % 7), true FROM s),
pr AS (SELECT "from", "to", bool_and(optional) AS optional FROM lk GROUP BY 1, 2),
fl AS (SELECT k, dir || v.f AS file, path FROM s, (VALUES ('/src/lib.rs', 2), ('/src/main.rs', 3), ('/src/bin/x.rs', 5)) v(f, every) WHERE k % v.every = 0),
us AS (SELECT path AS "from", CASE WHEN n = 1 THEN (SELECT path FROM s b WHERE b.k = (fl.k * 3) % 7 + 1) ELSE 'ext:far/ext-' || (k % 7) END AS "to", CASE n WHEN 1 THEN 2 ELSE 1 END AS w FROM fl, (VALUES (1), (2)) v(n)),
ul AS (SELECT pr."from", pr."to", coalesce(sum(w), 0)::BIGINT AS uses, any_value(optional) AS optional FROM pr LEFT JOIN us ON us."from" = pr."from" AND us."to" = pr."to" GROUP BY 1, 2),
api AS (SELECT path, 'f' || (k % 3) AS api FROM s WHERE k % 2 = 0),
bx AS (SELECT path AS key, name AS id, 'ws' || (k % 5) AS home, false AS external, (k * 7 * ((k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 5 = 0)::INT))::BIGINT AS lines, k % 3 = 0 OR k % 5 = 0 AS bin, k % 2 = 0 AS lib,
       CASE WHEN path NOT IN (SELECT "to" FROM pr) AND ((k % 3 = 0 OR k % 5 = 0) AND k % 2 <> 0 OR k % 11 = 0) THEN 'Frontend' ELSE 'Backend' END AS role, coalesce((SELECT api FROM api WHERE api.path = s.path), '') AS api, 0 AS o, path AS p FROM s
       UNION ALL SELECT 'ext:far/ext-' || (k % 7), 'ext:far/ext-' || (k % 7), 'far', true, 0, false, true, 'External', '', 1, min(path) FROM s GROUP BY k % 7),
dg AS (SELECT key, sum(uses + 1) AS d FROM (SELECT "from" AS key, uses FROM ul UNION ALL SELECT "to", uses FROM ul) GROUP BY key),
tb AS (SELECT key, (coalesce(d, 0) * 2 + lines // 400)::BIGINT AS score, role, home, o, p FROM bx LEFT JOIN dg USING (key))"""
_BOX = "(SELECT p_partkey AS id, p_partkey % 100 AS x, p_size * 2 AS y, p_partkey % 7 + 1 AS width, 5 AS height, p_size AS layer FROM part)"
_STEP = """st AS (SELECT o_orderkey // 50 AS beat, o_orderkey AS step, (o_custkey % 20)::VARCHAR AS node FROM orders WHERE o_orderkey % 50 < 4),
ln AS (SELECT DISTINCT (o_custkey % 20)::VARCHAR AS a, (o_orderkey % 20)::VARCHAR AS b FROM orders WHERE o_orderkey % 50 >= 40),
sb AS (SELECT *, lag(node) OVER (PARTITION BY beat ORDER BY step) AS before FROM st)"""

QUERIES = {
    f.__name__: f
    for f in (
        nearest_workspace, package_dependencies, external_packages, package_boxes, package_uses, topk_packages, package_record, story_steps, picture_extent, smallest_region, edge_kinds, focus_edges,
        adjacent_nodes, node_by_id, declarations,
    )
}
ORACLES = {
    "nearest_workspace": f"WITH {_S} SELECT path, 'ws' || (k % 5) AS home FROM s",
    "package_dependencies": f"""WITH {_S}, id AS (SELECT path, path || ':' || name AS id FROM s)
      SELECT a.id AS source, coalesce(b.id, pr."to") AS target, CASE WHEN optional THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM pr JOIN id a ON a.path = pr."from" LEFT JOIN id b ON b.path = pr."to\"""",
    "external_packages": "SELECT DISTINCT 'ext:far/ext-' || (s_suppkey % 7) AS id, 'far/lib' || (s_suppkey % 7) AS path, 'ext-' || (s_suppkey % 7) AS name, 'far' AS repo FROM supplier",
    "package_boxes": f"WITH {_S} SELECT id, home, external, lines, bin, lib, role, api FROM bx",
    "package_uses": f"WITH {_S} SELECT * FROM ul",
    "topk_packages": f"WITH {_S} SELECT key, score FROM tb ORDER BY score DESC, o, p LIMIT {TOP}",
    "package_record": f"WITH {_S}, t AS (SELECT * FROM tb ORDER BY score DESC, o, p LIMIT 48) SELECT 'component' AS what, role AS name, count(*) AS n FROM t GROUP BY role UNION ALL SELECT 'region', '', count(DISTINCT home) FROM t",
    "story_steps": f"""WITH {_STEP} SELECT beat, step, node, before, CASE WHEN before IS NULL THEN 'start' WHEN EXISTS (SELECT 1 FROM ln WHERE a = before AND b = node) AND EXISTS (SELECT 1 FROM ln WHERE a = node AND b = before) THEN 'both'
      WHEN EXISTS (SELECT 1 FROM ln WHERE a = before AND b = node) THEN 'forward' WHEN EXISTS (SELECT 1 FROM ln WHERE a = node AND b = before) THEN 'reverse' ELSE 'group' END AS relation FROM sb""",
    "picture_extent": f"SELECT layer, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM {_BOX} GROUP BY layer",
    "smallest_region": f"SELECT id, CASE WHEN x BETWEEN 40 AND 60 AND y BETWEEN 20 AND 50 THEN 'mid' WHEN x <= 50 AND y <= 200 THEN 'left' WHEN x <= 200 AND y <= 200 THEN 'all' END AS region FROM {_BOX}",
    "edge_kinds": "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'emphasis' WHEN 1 THEN 'emphasis' WHEN 2 THEN 'security' WHEN 3 THEN 'dashed' WHEN 4 THEN 'dashed' WHEN 5 THEN 'dotted' ELSE 'default' END AS kind FROM part",
    "focus_edges": f"WITH {D.SQL}, c AS (SELECT id FROM nodes WHERE kind IN ('File', 'Crate')) SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)",
    "adjacent_nodes": f"WITH {D.SQL}, n AS (SELECT 'file:crates/r0/src/n0.rs' AS id) SELECT id FROM n UNION SELECT target FROM edges JOIN n ON source = id UNION SELECT source FROM edges JOIN n ON target = id",
    "node_by_id": f"WITH {D.SQL} SELECT id, name, kind FROM nodes WHERE id = 'file:crates/r1/src/n1.rs'",
    "declarations": f"WITH {D.SQL} SELECT name, kind, path, (SELECT count(*) FROM edges WHERE target = nodes.id) AS refs, ord FROM nodes WHERE kind <> 'File' AND regexp_matches('fn ' || name, '(?i)^FN FN_1.$')",
}
