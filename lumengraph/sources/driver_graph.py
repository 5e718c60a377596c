"""A code graph made of the driver's tables, as DataFrames and as SQL for the oracle queries.

Regions are packages, nations their source files, customers functions (whose names repeat),
suppliers classes and parts data files. Orders are calls, line items reads and writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.runtime import dealt, table


@dataclass
class Graph:
    nodes: DataFrame  # ord, id, path, name, kind
    edges: DataFrame  # ord, source, target, relation, confidence


def load(spark: SparkSession, sf_dir: str) -> Graph:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier, part = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    orders, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    box = F.concat(F.lit("crates/r"), F.col("n_regionkey"))
    files = nation.select(F.col("n_nationkey").alias("n"), F.concat(box, F.lit("/src/n"), "n_nationkey", F.lit(".rs")).alias("path"))
    fn = F.concat(F.lit("fn_"), F.col("c_custkey") % 700)
    functions = customer.join(files, F.col("c_nationkey") == F.col("n")).select("c_custkey", "path", fn.alias("name"), F.concat("path", F.lit(":"), fn, F.lit("#"), "c_custkey").alias("id"))
    classes = supplier.join(files, F.col("s_nationkey") == F.col("n")).select("s_suppkey", "path", F.col("s_name").alias("name"), F.concat("path", F.lit(":"), "s_name").alias("id"))
    data = F.concat(F.lit("artifact:part"), F.col("p_partkey"), F.lit(".csv"))
    package = lambda k: F.concat(F.lit("crates/r"), k, F.lit("/Cargo.toml:r"), k)
    node = lambda df, n, i, p, name, kind: df.select(n.cast("bigint").alias("ord"), i.alias("id"), p.alias("path"), name.alias("name"), F.lit(kind).alias("kind"))
    r = F.col("r_regionkey")
    nodes = (
        node(region, r, package(r), F.concat(F.lit("crates/r"), r, F.lit("/Cargo.toml")), F.concat(F.lit("r"), r), "Crate")
        .union(node(files, F.col("n") + 1000, F.concat(F.lit("file:"), "path"), F.col("path"), F.concat(F.lit("n"), "n", F.lit(".rs")), "File"))
        .union(node(functions, F.col("c_custkey") + 10_000, F.col("id"), F.col("path"), F.col("name"), "Function"))
        .union(node(classes, F.col("s_suppkey") + 1_000_000_000, F.col("id"), F.col("path"), F.col("name"), "Class"))
        .union(node(part, F.col("p_partkey") + 2_000_000_000, data, F.lit(""), F.concat(F.lit("part"), "p_partkey", F.lit(".csv")), "Artifact"))
    )
    edge = lambda df, n, s, t, relation, c=1.0: df.select(n.cast("bigint").alias("ord"), s.alias("source"), t.alias("target"), F.lit(relation).alias("relation"), F.lit(c).alias("confidence"))
    to = files.select(F.col("n").alias("m"), F.col("path").alias("other"))
    meant = F.explode(F.array_distinct(F.array((F.col("n") + 7) % 25, (F.col("n") * 3 + 1) % 25))).alias("m")
    imports = files.select("n", "path", meant).join(to, "m").where("n <> m")
    caller = functions.select(F.col("c_custkey").alias("a"), F.col("id").alias("source"))
    callee = functions.select(F.col("c_custkey").alias("b"), F.col("id").alias("target"))
    calls = orders.join(caller, F.col("o_custkey") == F.col("a")).join(callee, F.col("o_orderkey") % 1000 + 1 == F.col("b"))
    # Pairs hardly repeat, so they are dealt before they are made distinct, and by the key of the join that follows.
    lines = item.count()  # from the files' footers
    writes = dealt(item.select("l_suppkey", "l_partkey"), "l_suppkey", rows=lines).distinct().join(classes, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = item.select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    reads = dealt(bought, "o_custkey", rows=lines).distinct().join(caller, F.col("o_custkey") == F.col("a"))
    goods = F.concat(F.lit("artifact:part"), F.col("l_partkey"), F.lit(".csv"))
    source = F.concat(F.lit("file:"), "path")
    edges = (
        edge(functions, F.col("c_custkey"), source, F.col("id"), "Contains")
        .union(edge(classes, F.col("s_suppkey") + 1_000_000_000, source, F.col("id"), "Contains"))
        .union(edge(imports, F.col("n") * 100 + F.col("m") + 2_000_000_000, source, F.concat(F.lit("file:"), "other"), "Imports"))
        .union(edge(region, r + 3_000_000_000, package(r), package((r + 1) % 5), "DependsOn"))
        .union(edge(calls, F.col("o_orderkey") + 4_000_000_000, F.col("source"), F.col("target"), "Calls", 0.9))
        .union(edge(writes, F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") + 50_000_000_000, F.col("id"), goods, "Writes", 0.9))
        .union(edge(reads, F.col("o_custkey") * 1_000_000 + F.col("l_partkey") + 900_000_000_000_000, F.col("source"), goods, "Reads", 0.9))
    )
    return Graph(nodes, edges)


#: The same as common table expressions.
SQL = """
files AS MATERIALIZED (SELECT n_nationkey AS n, 'crates/r' || n_regionkey || '/src/n' || n_nationkey || '.rs' AS path FROM nation),
fns AS MATERIALIZED (SELECT c_custkey, path, 'fn_' || (c_custkey % 700) AS name, path || ':fn_' || (c_custkey % 700) || '#' || c_custkey AS id FROM customer JOIN files ON c_nationkey = n),
cls AS MATERIALIZED (SELECT s_suppkey, path, s_name AS name, path || ':' || s_name AS id FROM supplier JOIN files ON s_nationkey = n),
nodes AS MATERIALIZED (
  SELECT r_regionkey::BIGINT AS ord, 'crates/r' || r_regionkey || '/Cargo.toml:r' || r_regionkey AS id, 'crates/r' || r_regionkey || '/Cargo.toml' AS path, 'r' || r_regionkey AS name, 'Crate' AS kind FROM region
  UNION ALL SELECT n + 1000, 'file:' || path, path, 'n' || n || '.rs', 'File' FROM files
  UNION ALL SELECT c_custkey + 10000, id, path, name, 'Function' FROM fns
  UNION ALL SELECT s_suppkey + 1000000000, id, path, name, 'Class' FROM cls
  UNION ALL SELECT p_partkey + 2000000000, 'artifact:part' || p_partkey || '.csv', '', 'part' || p_partkey || '.csv', 'Artifact' FROM part),
edges AS MATERIALIZED (
  SELECT c_custkey::BIGINT AS ord, 'file:' || path AS source, id AS target, 'Contains' AS relation, 1.0::DOUBLE AS confidence FROM fns
  UNION ALL SELECT s_suppkey + 1000000000, 'file:' || path, id, 'Contains', 1.0 FROM cls
  UNION ALL SELECT a.n * 100 + b.n + 2000000000, 'file:' || a.path, 'file:' || b.path, 'Imports', 1.0 FROM files a JOIN files b ON (b.n = (a.n + 7) % 25 OR b.n = (a.n * 3 + 1) % 25) AND a.n <> b.n
  UNION ALL SELECT r_regionkey + 3000000000, 'crates/r' || r_regionkey || '/Cargo.toml:r' || r_regionkey, 'crates/r' || ((r_regionkey + 1) % 5) || '/Cargo.toml:r' || ((r_regionkey + 1) % 5), 'DependsOn', 1.0 FROM region
  UNION ALL SELECT o_orderkey + 4000000000, a.id, b.id, 'Calls', 0.9 FROM orders JOIN fns a ON o_custkey = a.c_custkey JOIN fns b ON o_orderkey % 1000 + 1 = b.c_custkey
  UNION ALL SELECT l_suppkey * 1000000 + l_partkey + 50000000000, id, 'artifact:part' || l_partkey || '.csv', 'Writes', 0.9 FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN cls ON l_suppkey = s_suppkey
  UNION ALL SELECT o_custkey * 1000000 + l_partkey + 900000000000000, id, 'artifact:part' || l_partkey || '.csv', 'Reads', 0.9
    FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN fns ON o_custkey = c_custkey)
"""
