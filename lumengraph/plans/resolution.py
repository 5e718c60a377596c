"""Queries for resolution, roll-ups, deltas and labels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.operators import delta, relink, resolve, rollup
from lumengraph.runtime import durable, table
from lumengraph.sources import driver_graph as D


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.load(spark, sf_dir).nodes.where("kind = 'Function'")
    return nodes.select("id", "name", "ord", F.col("path").alias("file"), F.regexp_extract("path", "^(crates/r[0-9]+)/", 1).alias("package"), (F.col("ord") % 3 == 0).alias("is_pub"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = _functions(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    rows = orders.join(fns, F.col("o_custkey") + 10_000 == F.col("ord"))
    return rows.select(F.col("id").alias("caller"), F.col("o_orderkey").alias("tok_ord"), F.concat(F.lit("fn_"), F.col("o_orderkey") % 1400).alias("name"), "file", "package")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = D.load(spark, sf_dir).edges.where("relation = 'Imports'")
    return edges.select(F.expr("substring(source, 6)").alias("file"), F.expr("substring(target, 6)").alias("other_file"))


def _package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = D.load(spark, sf_dir).edges.where("relation = 'DependsOn'")
    cut = lambda c: F.regexp_extract(c, "^(crates/r[0-9]+)/", 1)
    return edges.select(cut("source").alias("package"), cut("target").alias("other_package"))


def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one definition anywhere; every third customer's name is its own."""
    name = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("own_"), F.col("ord") - 10_000)).otherwise(F.col("name"))
    calls = _calls(spark, sf_dir).withColumn("name", F.when(F.col("tok_ord") % 2 == 0, F.concat(F.lit("own_"), F.col("tok_ord") % 1500)).otherwise(F.col("name")))
    return resolve.unique_name(calls, _functions(spark, sf_dir).withColumn("name", name))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of forty types; some have names that say nothing."""
    k = F.col("ord") - 10_000
    return _functions(spark, sf_dir).withColumns({"owner": F.concat(F.lit("T"), k % 40), "name": F.when(k % 6 == 0, "push").otherwise(F.concat(F.lit("m_"), k % 90))})


def _method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, own = table(spark, sf_dir, "orders"), _methods(spark, sf_dir).select("id", "ord", "file", "package", "owner")
    rows = orders.join(own, F.col("o_custkey") + 10_000 == F.col("ord"))
    name = F.when(F.col("o_orderkey") % 6 == 0, "push").otherwise(F.concat(F.lit("m_"), F.col("o_orderkey") % 90))
    return rows.select(F.col("id").alias("caller"), F.col("o_orderkey").alias("tok_ord"), name.alias("name"), "file", "package", "owner", F.concat(F.lit("T"), F.col("o_orderkey") % 40).alias("type"))


def method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`.name`, by the caller's own type, its file, scope and package."""
    return resolve.resolve(_method_calls(spark, sf_dir).drop("type"), _methods(spark, sf_dir), resolve.method_rules(_imports(spark, sf_dir)))


def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`Type::name`, by the type in the file, in scope and in the package."""
    return resolve.resolve(_method_calls(spark, sf_dir).drop("owner").withColumnRenamed("type", "owner"), _methods(spark, sf_dir), resolve.typed_rules(_imports(spark, sf_dir)))


def rust_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token shapes of a file at once: `module::name` and plain names."""
    fns = _functions(spark, sf_dir).withColumn("owner", F.lit(None).cast("string"))
    calls = _calls(spark, sf_dir)
    token = F.when(F.col("tok_ord") % 3 == 0, F.concat(F.lit("n"), F.col("tok_ord") % 25, F.lit("::"), "name")).otherwise(F.col("name"))
    calls = calls.select("caller", "tok_ord", token.alias("token"), "file", "package", F.lit(None).cast("string").alias("owner"))
    imports = _imports(spark, sf_dir)
    modules = imports.select("file", P.module_name(F.col("other_file")).alias("qualifier"), "other_file")
    return resolve.resolve_rust(calls, fns, imports, _package_deps(spark, sf_dir), modules).drop("tok_ord")


def tiered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fns = _functions(spark, sf_dir)
    rules = resolve.free_function_rules(_imports(spark, sf_dir), _package_deps(spark, sf_dir), fns)
    return resolve.resolve(_calls(spark, sf_dir), fns, rules)


def relinked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same calls, brought up to date from what they were before the files of some nations changed.

    Those files called other names, lacked every third function, had others under another name and one import fewer.
    """
    fns, calls, imports, deps = _functions(spark, sf_dir), _calls(spark, sf_dir), _imports(spark, sf_dir), _package_deps(spark, sf_dir)
    edited = F.col("file").rlike(r"[27][.]rs$")  # every fifth nation
    k = F.col("ord")
    fns_then = fns.where(~edited | (k % 3 != 0)).withColumn("name", F.when(edited & (k % 4 == 0), F.concat("name", F.lit("_then"))).otherwise(F.col("name")))
    calls_then = calls.withColumn("name", F.when(edited & (F.col("tok_ord") % 2 == 0), F.concat("name", F.lit("_then"))).otherwise(F.col("name"))).join(fns_then.select(F.col("id").alias("caller")), "caller", "left_semi")
    imports_then = imports.where(~edited | (F.col("other_file") > F.col("file")))
    before = relink.State(calls_then, fns_then, resolve.free_function_rules(imports_then, deps, fns_then))
    after = relink.State(calls, fns, resolve.free_function_rules(imports, deps, fns))
    then = durable(resolve.resolve(before.calls, before.definitions, before.rules), "then")
    return relink.relink(then, before, after)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.call_edges(tiered_calls(spark, sf_dir)).drop("tok_ord")


def owner_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.load(spark, sf_dir).nodes
    files = nodes.where("kind IN ('File', 'Function')").select("path").distinct()
    packages = nodes.where("kind = 'Crate'").select("id", "ord", P.directory(F.col("path")).alias("dir"))
    inner = nodes.where("kind = 'File' AND ord % 2 = 0").select("id", "ord", P.directory(F.col("path")).alias("dir"))
    return rollup.owners(files, packages.union(inner))


def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.modules(rollup.modules_of(D.load(spark, sf_dir).nodes))


def module_dependencies_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return rollup.dependencies(rollup.modules_of(g.nodes), g.edges)


def topk_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    placed = rollup.modules_of(g.nodes)
    return rollup.top_modules(rollup.modules(placed), rollup.dependencies(placed, g.edges), 9)


def topk_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    placed = rollup.modules_of(g.nodes)
    deps = rollup.dependencies(placed, g.edges)
    return rollup.top_dependencies(deps, rollup.top_modules(rollup.modules(placed), deps, 9), 20)


def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return rollup.weighted_degree(rollup.dependencies(rollup.modules_of(g.nodes), g.edges), weight=F.col("count"))


def heaviest_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return rollup.heaviest_outgoing(rollup.dependencies(rollup.modules_of(g.nodes), g.edges))


def artifact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.artifact_ranking(D.load(spark, sf_dir).edges)


def artifact_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.artifact_users(D.load(spark, sf_dir).edges)


def users_top4_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.shown_users(D.load(spark, sf_dir).edges)


def public_api_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.public_api(_functions(spark, sf_dir), D.load(spark, sf_dir).edges.where("relation = 'Calls'"))


def cross_package_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cross_package_callers(D.load(spark, sf_dir).edges.where("relation = 'Calls'"), _functions(spark, sf_dir))


def import_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weighted_degree(D.load(spark, sf_dir).edges.where("relation = 'Imports'"), "source", "target")


def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    links = rows.select(F.col("c_nationkey").alias("from"), (F.col("o_orderkey") % 25).cast("int").alias("to"), F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(1.0).alias("weight"), (F.col("o_orderstatus") == "F").alias("optional"))
    return rollup.merged_links(links)


def lines_per_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from `loc:` facts, summed per owner."""
    facts = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("loc:"), F.size(F.split("text", "\n"))).alias("fact"))
    return facts.groupBy("source").agg(F.sum(F.try_to_number(F.expr("substring(fact, 5)"), F.lit("999999999"))).cast("bigint").alias("lines"))


def role_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.element_at(F.array(*[F.lit(w) for w in ("auth-kit", "GUI_view", "index.build", "guide", "EventStream bus", "aws cloud", "vendor sdk", "KASA", "TEMA panel", "plain")]), (F.col("p_partkey") % 10 + 1).cast("int"))
    region = F.when(F.col("p_size") > 25, "db").otherwise("core")
    return part.select("p_partkey", L.role_for(name, region).alias("role"))


def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.legend(role_inference(spark, sf_dir))


def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.load(spark, sf_dir).edges.groupBy("relation").agg(F.count("*").alias("n"))
    return rows.select("relation", *[L.relation_label(F.col("relation"), k).alias(k) for k in L.LOCALES], L.uses_label(F.col("n"), "tr").alias("uses"), L.counts_label(F.col("n"), F.col("n") + 1, "en").alias("counts"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", P.join_norm(F.concat(F.lit("a/b/c"), "p_size"), F.concat(F.lit("../"), F.when(F.col("p_size") % 2 == 0, "./x").otherwise("../../../y"), F.lit("/"), "p_partkey")).alias("path"))


def delta_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    half = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("label"), F.max("o_orderstatus").alias("role"))
    return delta.components(half(0), half(1), ["label", "role"])


def delta_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("from"), F.col("o_orderpriority").alias("to"), "o_orderkey")
    return delta.connections(orders.where("o_orderkey % 5 < 2"), orders.where("o_orderkey % 5 >= 2"))


def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.md5(F.col("p_name").cast("binary")).alias("hash"))
    new = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 5 == 1, "!").otherwise("")).cast("binary")).alias("hash"))
    return delta.changes(old, new)


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "event_id").alias("path"), F.col("ts").alias("modificationTime"))
    return delta.stale(listed, F.lit("2024-01-20 00:00:00").cast("timestamp"))


def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", delta.fnv1a("c_name").alias("hash"))


def forget_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the files of one package go, and one of them comes back."""
    nodes = D.load(spark, sf_dir).nodes.withColumn("owner_path", F.col("path"))
    gone = nodes.where("path LIKE 'crates/r1/src/%'").select("path").distinct()
    back = nodes.where("path = 'crates/r1/src/n1.rs'")
    return delta.absorb(delta.forget(nodes, gone), back, ["id"]).select("id", "ord")


def status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " Done ").when(F.col("toxic") == 1, "ERTELENDİ").when(F.col("doc_id") % 2 == 0, "KISMİ").otherwise("someday")
    return table(spark, sf_dir, "labels").select("doc_id", L.status_of(word).alias("state"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = status_board(spark, sf_dir)
    states = [*L.STATUS_WORDS, L.UNREADABLE]
    return rows.agg(F.count("*").alias("goals"), *[F.count_if(F.col("state") == s).alias(s) for s in states], (F.coalesce(F.bool_and(F.col("state") == "done"), F.lit(False))).alias("green"))


_FN = "fn AS (SELECT id, name, ord, path AS file, regexp_extract(path, '^(crates/r[0-9]+)/', 1) AS package, ord % 3 = 0 AS is_pub FROM nodes WHERE kind = 'Function')"
_CALLS = "cl AS (SELECT f.id AS caller, o_orderkey AS tok_ord, 'fn_' || (o_orderkey % 1400) AS name, f.file, f.package FROM orders JOIN fn f ON o_custkey + 10000 = f.ord)"
_IMP = "imp AS (SELECT DISTINCT substr(source, 6) AS file, substr(target, 6) AS other FROM edges WHERE relation = 'Imports')"
_DEP = "dep AS (SELECT DISTINCT regexp_extract(source, '^(crates/r[0-9]+)/', 1) AS p, regexp_extract(target, '^(crates/r[0-9]+)/', 1) AS q FROM edges WHERE relation = 'DependsOn')"
_TIERS = f"""{D.SQL}, {_FN}, {_CALLS}, {_IMP}, {_DEP},
c AS (SELECT cl.caller, cl.tok_ord, fn.id AS target, fn.file = cl.file AS t1, fn.file = cl.file OR EXISTS (SELECT 1 FROM imp WHERE imp.file = cl.file AND imp.other = fn.file) AS t2,
      fn.package = cl.package AS t3, fn.is_pub AND EXISTS (SELECT 1 FROM dep WHERE dep.p = cl.package AND dep.q = fn.package) AS t4 FROM cl JOIN fn ON fn.name = cl.name),
u AS (SELECT caller, tok_ord, target, tier, conf FROM c, LATERAL (VALUES (0, 0.95, t1), (1, 0.90, t2), (2, 0.75, t3), (3, 0.60, t4)) v(tier, conf, ok) WHERE ok),
w AS (SELECT caller, tok_ord, tier, min(target) AS target, any_value(conf) AS conf FROM u GROUP BY ALL HAVING count(*) = 1),
res AS (SELECT caller, tok_ord, arg_min(target, tier) AS target, arg_min(conf, tier)::DOUBLE AS confidence FROM w GROUP BY caller, tok_ord)"""
_FIRST = """u AS (SELECT caller, tok_ord, target, tier, conf FROM c, LATERAL (VALUES {tiers}) v(tier, conf, ok) WHERE ok),
w AS (SELECT caller, tok_ord, tier, min(target) AS target, any_value(conf) AS conf FROM u GROUP BY ALL HAVING count(*) = 1),
res AS (SELECT caller, tok_ord, arg_min(target, tier) AS target, arg_min(conf, tier)::DOUBLE AS confidence FROM w GROUP BY caller, tok_ord)"""
_METHODS = f"""{D.SQL}, {_FN}, {_IMP}, m AS (SELECT id, ord, file, package, 'T' || ((ord - 10000) % 40) AS owner, CASE WHEN (ord - 10000) % 6 = 0 THEN 'push' ELSE 'm_' || ((ord - 10000) % 90) END AS name FROM fn),
mc AS (SELECT m.id AS caller, o_orderkey AS tok_ord, CASE WHEN o_orderkey % 6 = 0 THEN 'push' ELSE 'm_' || (o_orderkey % 90) END AS name, file, package, owner, 'T' || (o_orderkey % 40) AS type FROM orders JOIN m ON o_custkey + 10000 = m.ord)"""
_MOD = f"""{D.SQL},
m AS (SELECT *, split_part(path, '/', 2) AS region, regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', '') AS module, split_part(path, '/', 2) || '/' || regexp_replace(split_part(path, '/', 4), '\\.[^.]*$', '') AS key
      FROM nodes WHERE kind IN ('File', 'Function', 'Class')),
ms AS (SELECT key, region, module, count(*) FILTER (WHERE kind = 'File') AS files, count(*) FILTER (WHERE kind <> 'File') AS symbols FROM m GROUP BY ALL),
df AS (SELECT DISTINCT name, region, key FROM m WHERE kind = 'Function'),
l AS (SELECT a.key AS "from", b.key AS "to", e.relation, b.name AS called, a.region AS own FROM edges e JOIN m a ON e.source = a.id JOIN m b ON e.target = b.id WHERE e.relation <> 'Contains' AND a.key <> b.key),
k AS (SELECT "from", "to", relation FROM l WHERE relation <> 'Calls' OR (SELECT count(*) FROM df WHERE df.name = called) <= 1
      OR ((SELECT count(*) FROM df WHERE df.name = called AND df.region = own) = 1 AND (SELECT min(key) FROM df WHERE df.name = called AND df.region = own) = "to" AND NOT EXISTS (SELECT 1 FROM df WHERE df.name = called AND df.key = "from"))),
dp AS (SELECT "from", "to", sum(n)::BIGINT AS "count", arg_max(relation, n * 100 + CASE relation WHEN 'Calls' THEN 5 WHEN 'Imports' THEN 4 ELSE 6 END) AS dominant
       FROM (SELECT "from", "to", relation, count(*) AS n FROM k GROUP BY ALL) GROUP BY "from", "to"),
dg AS (SELECT key, sum(w)::BIGINT AS degree FROM (SELECT "from" AS key, "count" AS w FROM dp UNION ALL SELECT "to", "count" FROM dp) GROUP BY key),
tp AS (SELECT key, (coalesce(degree, 0) * 2 + files + symbols // 4)::BIGINT AS score FROM ms LEFT JOIN dg USING (key) ORDER BY score DESC, key LIMIT 9)"""
_IO = "io AS (SELECT * FROM edges WHERE relation IN ('Writes', 'Reads'))"
_ROLE_NAME = "(['auth-kit', 'GUI_view', 'index.build', 'guide', 'EventStream bus', 'aws cloud', 'vendor sdk', 'KASA', 'TEMA panel', 'plain'])[p_partkey % 10 + 1]"
_ROLES = f"""(SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'Security' WHEN 1 THEN 'Frontend' WHEN 2 THEN 'Database' WHEN 4 THEN 'Messagebus' WHEN 5 THEN 'Cloud' WHEN 6 THEN 'External' WHEN 7 THEN 'Security' WHEN 8 THEN 'Frontend'
  ELSE CASE WHEN p_size > 25 THEN 'Database' ELSE 'Backend' END END AS role FROM part)"""
_STATE = "(SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'done' WHEN toxic = 1 THEN 'deferred' WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'unreadable' END AS state FROM labels)"

QUERIES = {
    f.__name__: f
    for f in (
        unique_resolution, tiered_calls, relinked_calls, method_calls, typed_calls, rust_call_edges, call_edges, owner_longest_prefix, module_rollup, module_dependencies_dominant, topk_modules, topk_dependencies, weighted_degree, heaviest_outgoing,
        artifact_ranking, artifact_users, users_top4_hidden, public_api_top4, cross_package_callers, import_degree, merged_links, lines_per_package, role_inference, legend_counts, relation_labels,
        path_normalize, delta_components, delta_connections, incremental_changes, freshness, fnv1a_hash, forget_owner, status_board, status_counts,
    )
}
ORACLES = {
    "unique_resolution": f"""WITH {D.SQL}, {_FN}, {_CALLS}, f AS (SELECT id, CASE WHEN ord % 3 = 0 THEN 'own_' || (ord - 10000) ELSE name END AS name FROM fn), c AS (SELECT caller, tok_ord, CASE WHEN tok_ord % 2 = 0 THEN 'own_' || (tok_ord % 1500) ELSE name END AS name FROM cl)
      SELECT caller, tok_ord, min(f.id) AS target, 1.0::DOUBLE AS confidence FROM c JOIN f USING (name) GROUP BY caller, tok_ord HAVING count(*) = 1""",
    "method_calls": f"""WITH {_METHODS}, c AS (SELECT mc.caller, mc.tok_ord, m.id AS target, m.file = mc.file AND m.owner = mc.owner AS t1, mc.name <> 'push' AND m.file = mc.file AS t2,
      mc.name <> 'push' AND (m.file = mc.file OR EXISTS (SELECT 1 FROM imp WHERE imp.file = mc.file AND imp.other = m.file)) AS t3, mc.name <> 'push' AND m.package = mc.package AS t4 FROM mc JOIN m ON m.name = mc.name), {_FIRST.format(tiers="(0, 0.85, t1), (1, 0.70, t2), (2, 0.65, t3), (3, 0.55, t4)")} SELECT * FROM res""",
    "typed_calls": f"""WITH {_METHODS}, c AS (SELECT mc.caller, mc.tok_ord, m.id AS target, m.file = mc.file AS t1, m.file = mc.file OR EXISTS (SELECT 1 FROM imp WHERE imp.file = mc.file AND imp.other = m.file) AS t2, m.package = mc.package AS t3
      FROM mc JOIN m ON m.name = mc.name AND m.owner = mc.type), {_FIRST.format(tiers="(0, 0.85, t1), (1, 0.85, t2), (2, 0.85, t3)")} SELECT * FROM res""",
    "rust_call_edges": f"""WITH {_TIERS.replace("FROM orders JOIN fn f ON o_custkey + 10000 = f.ord", "FROM orders JOIN fn f ON o_custkey + 10000 = f.ord WHERE o_orderkey % 3 <> 0")},
      mo AS (SELECT f.id AS caller, o_orderkey AS tok_ord, min(t.id) AS target, 0.95::DOUBLE AS confidence FROM orders JOIN fn f ON o_custkey + 10000 = f.ord JOIN imp ON imp.file = f.file AND imp.other LIKE '%/n' || (o_orderkey % 25) || '.rs'
        JOIN fn t ON t.file = imp.other AND t.name = 'fn_' || (o_orderkey % 1400) WHERE o_orderkey % 3 = 0 GROUP BY ALL HAVING count(*) = 1)
      SELECT caller AS source, target, arg_min(confidence, tok_ord) AS confidence FROM (SELECT * FROM res UNION ALL SELECT * FROM mo) WHERE caller <> target GROUP BY ALL""",
    "relinked_calls": f"WITH {_TIERS} SELECT * FROM res",
    "tiered_calls": f"WITH {_TIERS} SELECT * FROM res",
    "call_edges": f"WITH {_TIERS} SELECT caller AS source, target, arg_min(confidence, tok_ord) AS confidence FROM res WHERE caller <> target GROUP BY ALL",
    "owner_longest_prefix": f"WITH {D.SQL}, p AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, arg_max(id, ord) AS package FROM nodes WHERE kind = 'Crate' OR (kind = 'File' AND ord % 2 = 0) GROUP BY 1), f AS (SELECT DISTINCT path FROM nodes WHERE kind IN ('File', 'Function')) SELECT path, arg_max(package, length(dir)) AS package FROM f JOIN p ON starts_with(path, dir || '/') GROUP BY path",
    "module_rollup": f"WITH {_MOD} SELECT * FROM ms",
    "module_dependencies_dominant": f"WITH {_MOD} SELECT * FROM dp",
    "topk_modules": f"WITH {_MOD} SELECT * FROM tp",
    "topk_dependencies": f"WITH {_MOD} SELECT * FROM dp WHERE \"from\" IN (SELECT key FROM tp) AND \"to\" IN (SELECT key FROM tp) ORDER BY \"count\" DESC, \"from\", \"to\" LIMIT 20",
    "weighted_degree": f"WITH {_MOD} SELECT * FROM dg",
    "heaviest_outgoing": f"WITH {_MOD} SELECT \"from\", \"to\", \"count\" FROM (SELECT *, row_number() OVER (PARTITION BY \"from\" ORDER BY \"count\" DESC, \"to\") AS p FROM dp) WHERE p = 1",
    "artifact_ranking": f"WITH {D.SQL}, {_IO} SELECT target AS artifact, bool_or(relation = 'Writes') AND bool_or(relation = 'Reads') AS two_way, count(DISTINCT source) AS users FROM io GROUP BY target ORDER BY two_way DESC, users DESC, artifact LIMIT 10",
    "artifact_users": f"WITH {D.SQL}, {_IO} SELECT target AS artifact, source AS \"user\", bool_or(relation = 'Writes') AS writes, bool_or(relation = 'Reads') AS reads FROM io GROUP BY ALL",
    "users_top4_hidden": f"WITH {D.SQL}, {_IO}, u AS (SELECT target AS artifact, source AS \"user\", min(ord) AS ord FROM io GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY ord, \"user\") AS place, greatest(count(*) OVER (PARTITION BY artifact) - 4, 0) AS hidden FROM u) SELECT artifact, place, \"user\", hidden FROM r WHERE place <= 4",
    "public_api_top4": f"WITH {D.SQL}, {_FN}, o AS (SELECT t.package, t.name, count(*) AS callers, min(t.ord) AS ord FROM edges e JOIN fn s ON e.source = s.id JOIN fn t ON e.target = t.id WHERE e.relation = 'Calls' AND t.is_pub AND s.package <> t.package GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY callers DESC, ord) AS place FROM o) SELECT package, place, name, callers FROM r WHERE place <= 4",
    "cross_package_callers": f"WITH {D.SQL}, {_FN} SELECT e.target, arg_min(e.source, e.ord) AS source, min(e.ord) AS ord FROM edges e JOIN fn s ON e.source = s.id JOIN fn t ON e.target = t.id WHERE e.relation = 'Calls' AND s.package <> t.package GROUP BY e.target ORDER BY 3 LIMIT 10",
    "import_degree": f"WITH {D.SQL} SELECT key, count(*) AS degree FROM (SELECT source AS key FROM edges WHERE relation = 'Imports' UNION ALL SELECT target FROM edges WHERE relation = 'Imports') GROUP BY key",
    "merged_links": "SELECT c_nationkey AS \"from\", (o_orderkey % 25)::INTEGER AS \"to\", max(CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight, bool_and(o_orderstatus = 'F') AS optional FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey <> o_orderkey % 25 GROUP BY 1, 2",
    "lines_per_package": "SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source",
    "role_inference": f"SELECT * FROM {_ROLES}",
    "legend_counts": f"SELECT role, list_position(['Frontend', 'Backend', 'Database', 'Cloud', 'Security', 'Messagebus', 'External'], role)::BIGINT AS place, count(*) AS n FROM {_ROLES} GROUP BY role",
    "relation_labels": f"WITH {D.SQL}, t(relation, tr, ar, en) AS (VALUES {', '.join(str((k, *v)) for k, v in L.RELATION_LABELS.items())}) SELECT relation, tr, ar, en, 'kullanır ×' || n AS uses, n || ' files · ' || (n + 1) || ' symbols' AS counts FROM (SELECT relation, count(*) AS n FROM edges GROUP BY relation) JOIN t USING (relation)",
    "path_normalize": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a/b/x/' ELSE 'y/' END || p_partkey AS path FROM part",
    "delta_components": "WITH b AS (SELECT o_custkey AS id, min(o_orderpriority) AS l, max(o_orderstatus) AS r FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey AS id, min(o_orderpriority) AS l, max(o_orderstatus) AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'Added' WHEN a.id IS NULL THEN 'Removed' WHEN a.l = b.l AND a.r = b.r THEN 'Unchanged' ELSE 'Modified' END AS status FROM b FULL JOIN a ON a.id = b.id",
    "delta_connections": "WITH o AS (SELECT o_custkey % 97 AS f, o_orderpriority AS t, o_orderkey % 5 < 2 AS old FROM orders), b AS (SELECT f, t FROM o WHERE old), a AS (SELECT f, t FROM o WHERE NOT old) SELECT f AS \"from\", t AS \"to\", CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.f = a.f AND b.t = a.t) THEN 'Unchanged' ELSE 'Added' END AS status FROM a UNION ALL SELECT f, t, 'Removed' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.f = b.f AND a.t = b.t)",
    "incremental_changes": "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 10 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 10 = 0 AND p_partkey % 7 <> 0) OR (p_partkey % 7 = 0 AND p_partkey % 10 <> 0) OR (p_partkey % 7 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 5 = 1)",
    "freshness": "SELECT 'f' || event_id AS path FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY path",
    "fnv1a_hash": "SELECT c_custkey, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS hash FROM (SELECT c_custkey, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(string_split(c_name, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM customer)",
    "forget_owner": f"WITH {D.SQL} SELECT id, ord FROM nodes WHERE path NOT LIKE 'crates/r1/src/%' OR path = 'crates/r1/src/n1.rs'",
    "status_board": f"SELECT * FROM {_STATE}",
    "status_counts": f"SELECT count(*) AS goals, {', '.join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in [*L.STATUS_WORDS, L.UNREADABLE])}, coalesce(bool_and(state = 'done'), false) AS green FROM {_STATE}",
}
