"""Queries over the graph: reports, rank, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import graph as G
from lumengraph.operators import grep, layering
from lumengraph.sources import driver_graph as D

SEEDS = [("file:crates/r0/src/n0.rs", 1.0), ("crates/r1/Cargo.toml:r1", 0.5), ("not a node", 3.0)]
ALPHA, ITERATIONS = 0.25, 12
START = "file:crates/r0/src/n0.rs"


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_degree(D.load(spark, sf_dir).edges)


def incoming_reference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.with_refs(g.nodes, g.edges).select("id", "refs")


def dir_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.directory_stats(D.load(spark, sf_dir).nodes)


def dir_hubs_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.directory_hubs(g.nodes, g.edges)


def hotspots_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.hotspots(g.nodes, g.edges)


def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.repo_map(g.nodes, g.edges, 4)


def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.histogram(D.load(spark, sf_dir).nodes, "kind")


def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.histogram(D.load(spark, sf_dir).edges, "relation")


def known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.known_edges(g.nodes.where("kind <> 'Class'"), g.edges).select("ord", "source", "target")


def graphrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.rank(g.nodes, g.edges, SEEDS, ALPHA, ITERATIONS).select("id", F.round("score", 6).alias("score"))


def graphrank_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as on a graph too large for the kernel."""
    g = D.load(spark, sf_dir)
    return G.rank(g.nodes, g.edges, SEEDS, ALPHA, ITERATIONS, kernel_size=0).select("id", F.round("score", 6).alias("score"))


def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.reachable(g.edges.where("relation IN ('Imports', 'Contains')"), START)


def three_hop_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    start = g.nodes.where("kind = 'Function'").orderBy("ord").first().id
    return G.reachable(g.edges.where("relation = 'Calls'"), start, 3)


def shortest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    path = G.shortest_path(g.nodes, g.edges.where("relation = 'Imports'"), START, "file:crates/r1/src/n21.rs") or []
    return spark.createDataFrame([(len(path), path[0] if path else None, path[-1] if path else None)], "n long, first string, last string")


def edge_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(D.load(spark, sf_dir).edges, START)


def source_hub_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return G.roles(g.nodes, g.edges)


def skeleton_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.skeleton(D.load(spark, sf_dir).nodes, "src\\n1.rs")


def trace_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.trace(D.load(spark, sf_dir).edges, ":fn_12#")


def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strong part of every node and its layer by longest ways, over all nodes and relations."""
    g = D.load(spark, sf_dir)
    return layering.layers(g.nodes, g.edges)


def _rank_sql(nodes: str, edges: str) -> str:
    steps = "".join(
        f""", r{k} AS MATERIALIZED (SELECT n.id, p.p, {1 - ALPHA} * (coalesce(s.got, 0) + p.p * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT source FROM od))) + {ALPHA} * p.p AS r
        FROM n JOIN pp p USING (id) LEFT JOIN (SELECT target AS id, sum(r / o) AS got FROM r{k - 1} JOIN od ON od.source = r{k - 1}.id JOIN e ON e.source = r{k - 1}.id GROUP BY target) s USING (id))"""
        for k in range(1, ITERATIONS + 1)
    )
    seeds = ", ".join(f"('{i}', {w})" for i, w in SEEDS)
    return f"""WITH {D.SQL}, n AS MATERIALIZED (SELECT DISTINCT id FROM nodes WHERE {nodes}),
    e AS MATERIALIZED (SELECT source, target FROM edges WHERE {edges} AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
    od AS MATERIALIZED (SELECT source, count(*) AS o FROM e GROUP BY source),
    sd AS (SELECT * FROM (VALUES {seeds}) AS v(id, w) WHERE id IN (SELECT id FROM n)),
    pp AS MATERIALIZED (SELECT n.id, coalesce(w, 0) / (SELECT sum(w) FROM sd) AS p FROM n LEFT JOIN sd USING (id)),
    r0 AS MATERIALIZED (SELECT id, p, p AS r FROM pp){steps}
    SELECT id, round(r, 6) AS score FROM r{ITERATIONS} WHERE r > 0.0001"""


_REFS = "(SELECT target AS id, count(*) AS refs FROM edges GROUP BY target)"
_DIR = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
_HUBS = f"""(SELECT dir, place, name, file, refs FROM (SELECT {_DIR} AS dir, name, regexp_extract(path, '([^/]*)$', 1) AS file, refs, row_number() OVER (PARTITION BY {_DIR} ORDER BY refs DESC, ord) AS place
  FROM nodes JOIN {_REFS} USING (id) WHERE kind <> 'File') WHERE place <= 3)"""
_STATS = f"(SELECT {_DIR} AS dir, count(*) FILTER (WHERE kind = 'File') AS files, count(*) FILTER (WHERE kind <> 'File') AS symbols FROM nodes GROUP BY 1)"
_REACH = """{name} AS (SELECT {start} AS id, 0 AS hops UNION SELECT target, hops + 1 FROM {name} JOIN edges ON source = id WHERE relation IN ({kinds}) AND hops < {most})"""

QUERIES = {
    "in_degree": in_degree, "incoming_reference_count": incoming_reference_count, "dir_stats": dir_stats, "dir_hubs_top3": dir_hubs_top3, "hotspots_top12": hotspots_top12,
    "repo_map": repo_map, "kind_histogram": kind_histogram, "relation_histogram": relation_histogram, "known_edges": known_edges, "graphrank": graphrank, "graphrank_joins": graphrank_joins,
    "reachable_set": reachable_set, "three_hop_calls": three_hop_calls, "shortest_route": shortest_route, "edge_directions": edge_directions, "source_hub_leaf": source_hub_leaf,
    "skeleton_suffix": skeleton_suffix, "trace_calls": trace_calls, "graph_layers": graph_layers,
}
ORACLES = {
    "in_degree": f"WITH {D.SQL} SELECT target AS id, count(*) AS refs FROM edges GROUP BY target",
    "incoming_reference_count": f"WITH {D.SQL} SELECT id, coalesce(refs, 0) AS refs FROM nodes LEFT JOIN {_REFS} USING (id)",
    "dir_stats": f"WITH {D.SQL} SELECT * FROM {_STATS}",
    "dir_hubs_top3": f"WITH {D.SQL} SELECT * FROM {_HUBS}",
    "hotspots_top12": f"WITH {D.SQL} SELECT name, kind, path, refs FROM nodes JOIN {_REFS} USING (id) WHERE kind <> 'File' ORDER BY refs DESC, ord LIMIT 12",
    "repo_map": f"""WITH {D.SQL}, s AS (SELECT * FROM {_STATS}), h AS (SELECT dir, string_agg(name || ' (' || file || ', ' || refs || '←)', ', ' ORDER BY place) AS hubs FROM {_HUBS} GROUP BY dir)
      SELECT dir, files, symbols, coalesce(hubs, '') AS hubs, 0::BIGINT AS more FROM (SELECT * FROM s ORDER BY dir LIMIT 4) LEFT JOIN h USING (dir)
      UNION ALL SELECT '~', 0, 0, '', count(*) - 4 FROM s HAVING count(*) > 4""",
    "kind_histogram": f"WITH {D.SQL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "relation_histogram": f"WITH {D.SQL} SELECT relation, count(*) AS n FROM edges GROUP BY relation",
    "known_edges": f"WITH {D.SQL}, k AS (SELECT id FROM nodes WHERE kind <> 'Class') SELECT ord, source, target FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "graphrank": _rank_sql("true", "true"),
    "graphrank_joins": _rank_sql("true", "true"),
    "reachable_set": f"WITH RECURSIVE {D.SQL}, {_REACH.format(name='w', start=f"'{START}'", kinds="'Imports', 'Contains'", most=12)} SELECT id, min(hops)::INTEGER AS hops FROM w GROUP BY id",
    "three_hop_calls": f"WITH RECURSIVE {D.SQL}, {_REACH.format(name='w', start="(SELECT arg_min(id, ord) FROM nodes WHERE kind = 'Function')", kinds="'Calls'", most=3)} SELECT id, min(hops)::INTEGER AS hops FROM w GROUP BY id",
    "shortest_route": f"WITH RECURSIVE {D.SQL}, {_REACH.format(name='w', start=f"'{START}'", kinds="'Imports'", most=12)} SELECT (min(hops) + 1)::BIGINT AS n, '{START}' AS first, 'file:crates/r1/src/n21.rs' AS last FROM w WHERE id = 'file:crates/r1/src/n21.rs'",
    "edge_directions": f"WITH {D.SQL} SELECT source, target, relation, CASE WHEN source = target THEN 'loop' WHEN source = '{START}' THEN 'out' ELSE 'in' END AS direction FROM edges WHERE source = '{START}' OR target = '{START}'",
    "source_hub_leaf": f"""WITH {D.SQL} SELECT id, coalesce(refs, 0) AS refs, coalesce(uses, 0) AS uses, CASE WHEN refs IS NULL AND uses IS NULL THEN 'isolated' WHEN refs IS NULL THEN 'source' WHEN uses IS NULL THEN 'leaf' ELSE 'hub' END AS role
      FROM nodes LEFT JOIN {_REFS} USING (id) LEFT JOIN (SELECT source AS id, count(*) AS uses FROM edges GROUP BY source) USING (id)""",
    "skeleton_suffix": f"WITH {D.SQL} SELECT path, ord, kind, name FROM nodes WHERE path LIKE '%src/n1.rs' AND kind <> 'File'",
    "trace_calls": f"""WITH {D.SQL} SELECT 'caller' AS side, source AS id, target AS of FROM edges WHERE relation = 'Calls' AND contains(target, ':fn_12#')
      UNION ALL SELECT 'callee', target, source FROM edges WHERE relation = 'Calls' AND contains(source, ':fn_12#')""",
    # What no edge leaves leads nowhere: only the others are followed to the end.
    "graph_layers": f"""WITH RECURSIVE {D.SQL},
      e AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE source <> target AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
      inner_e AS MATERIALIZED (SELECT source, target FROM e WHERE target IN (SELECT source FROM e) AND source IN (SELECT target FROM e)),
      lead AS (SELECT source AS a, target AS b FROM inner_e UNION SELECT a, target FROM lead JOIN inner_e ON source = b),
      m AS MATERIALIZED (SELECT * FROM lead),
      cyc AS (SELECT x.a AS id, min(x.b) AS part FROM m x JOIN m y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
      parts AS MATERIALIZED (SELECT DISTINCT id, least(coalesce(part, id), id) AS part FROM nodes LEFT JOIN cyc USING (id)),
      be AS MATERIALIZED (SELECT DISTINCT s.part AS a, t.part AS b FROM e JOIN parts s ON s.id = source JOIN parts t ON t.id = target WHERE s.part <> t.part),
      down AS (SELECT part, 0 AS layer FROM parts UNION SELECT b, layer + 1 FROM down JOIN be ON a = part)
      SELECT id, part, layer FROM parts JOIN (SELECT part, max(layer)::INTEGER AS layer FROM down GROUP BY part) USING (part)""",
}
