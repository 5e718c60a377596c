"""Roll-ups of a graph to modules and packages, and the cuts that diagrams make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.runtime import dealt, durable

UNCOUNTED = ("Crate", "ExternalCrate", "Artifact", "Test")


def counted(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """Nodes that belong to the architecture: no packages, data files, tests or manifests."""
    path = P.norm(F.col("path"))
    keep = ~F.col("kind").isin(*UNCOUNTED) & (path != "") & ~path.endswith(".toml") & ~path.endswith(".json")
    if scope is not None:
        keep = keep & path.startswith(f"{scope}/")
    return nodes.where(keep)


def common_prefix(files: DataFrame) -> tuple[int, str]:
    """Leading directory segments that all files share, and the root's name.

    Segments are compared by position and counted per position: no file is compared with another.
    """
    dirs = files.select(F.slice(P.parts(F.col("path")), F.lit(1), F.greatest(F.size(P.parts(F.col("path"))) - 1, F.lit(0))).alias("dirs"))
    total = dirs.count()
    if not total:
        return 0, "root"
    rows = dirs.select(F.posexplode("dirs").alias("at", "name")).groupBy("at").agg(F.count("*").alias("n"), F.count_distinct("name").alias("kinds"), F.min("name").alias("name")).where(f"n = {total} AND kinds = 1").orderBy("at").collect()
    shared = []
    for k, row in enumerate(rows):
        if row.at != k:
            break
        shared.append(row.name)
    if shared and shared[-1] in P.SOURCE_DIRS:
        shared.pop()
    return len(shared), shared[-1] if shared else "root"


def modules_of(nodes: DataFrame, scope: tuple[str, str] | None = None) -> DataFrame:
    """Counted nodes with their module: id, name, kind, region, module, key."""
    rows = counted(nodes, scope[0] if scope else None)
    prefix, root = (len([p for p in scope[0].split("/") if p]), scope[1]) if scope else common_prefix(rows.where("kind = 'File'"))
    placed = rows.withColumn("at", P.locate(F.col("path"), F.lit(prefix), F.lit(root))).where("at IS NOT NULL")
    # Written once: the roll-ups below meet it from several sides.
    return durable(placed.select("ord", "id", "name", "kind", "at.region", "at.module", F.concat_ws("/", "at.region", "at.module").alias("key")), "placed")


def modules(placed: DataFrame) -> DataFrame:
    """Files and symbols per module."""
    symbol = ~F.col("kind").isin("File", "Module")
    return placed.groupBy("key", "region", "module").agg(F.count_if(F.col("kind") == "File").alias("files"), F.count_if(symbol).alias("symbols"))


def dependencies(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, to, count, dominant) between modules.

    A call to a name that several modules define counts only if the caller's own module does not
    define it and exactly one module of the caller's region does, and that one is the target.
    """
    one = placed.select(F.col("id").alias("source"), F.col("key").alias("from"), F.col("region").alias("own"))
    two = placed.select(F.col("id").alias("target"), F.col("key").alias("to"), F.col("name").alias("called"))
    links = edges.where("relation <> 'Contains'").select("source", "target", "relation")
    # Targets first: data files and what lies outside are in no module, and go before sources are met.
    links = dealt(dealt(links, "target").join(two, "target"), "source").join(one, "source").where(F.col("from") != F.col("to"))
    links = durable(links, "module_links")
    definers = placed.where("kind IN ('Function', 'Method')").select("name", "region", "key").distinct()
    wide = definers.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("called"), F.lit(True).alias("ambiguous"))
    local = definers.groupBy(F.col("name").alias("called"), F.col("region").alias("own")).agg(F.count("*").alias("here"), F.min("key").alias("only"))
    mine = definers.select(F.col("name").alias("called"), F.col("key").alias("from"), F.lit(True).alias("defines"))
    calls = links.where("relation = 'Calls'").join(wide, "called", "left")
    sure = calls.where("ambiguous IS NULL")
    open_ = calls.where("ambiguous").join(local, ["called", "own"], "left").join(mine, ["called", "from"], "left")
    open_ = open_.where((F.col("here") == 1) & (F.col("only") == F.col("to")) & F.col("defines").isNull())
    kept = links.where("relation <> 'Calls'").select("from", "to", "relation").union(sure.select("from", "to", "relation")).union(open_.select("from", "to", "relation"))
    per = kept.groupBy("from", "to", "relation").agg(F.count("*").alias("n"))
    first = F.struct("n", L.relation_rank(F.col("relation")).alias("rank"), (-L.relation_place(F.col("relation"))).alias("place"))
    return durable(per.groupBy("from", "to").agg(F.sum("n").alias("count"), F.max_by("relation", first).alias("dominant")), "module_deps")


def weighted_degree(links: DataFrame, a: str = "from", b: str = "to", weight: Column | None = None) -> DataFrame:
    """Sum of the weights of the links at either end."""
    w = F.lit(1) if weight is None else weight
    ends = links.select(F.col(a).alias("key"), w.alias("w")).union(links.select(F.col(b).alias("key"), w.alias("w")))
    return ends.groupBy("key").agg(F.sum("w").alias("degree"))


def top_modules(mods: DataFrame, deps: DataFrame, k: int = 36) -> DataFrame:
    """The modules a diagram shows: by twice the degree plus files plus a quarter of the symbols."""
    rows = mods.join(weighted_degree(deps, weight=F.col("count")), "key", "left")
    score = F.coalesce("degree", F.lit(0)) * 2 + F.col("files") + F.floor(F.col("symbols") / 4)
    return rows.withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), "key").limit(k).select("key", "score")


def top_dependencies(deps: DataFrame, kept: DataFrame, k: int = 60) -> DataFrame:
    """The heaviest links between kept modules."""
    ends = kept.select(F.col("key"))
    inside = deps.join(ends.withColumnRenamed("key", "from"), "from", "left_semi").join(ends.withColumnRenamed("key", "to"), "to", "left_semi")
    return inside.orderBy(F.desc("count"), "from", "to").limit(k).select("from", "to", "count", "dominant")


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the package whose directory is the deepest above the file.

    Each path meets its own ancestors by equality; no prefix is compared. Of packages in one
    directory the last one counts; a package at the very top owns nothing.
    """
    dirs = packages.where("dir <> ''").groupBy("dir").agg(F.max_by("id", "ord").alias("package"))
    up = files.select("path", F.posexplode(P.ancestors(F.col("path"))).alias("depth", "dir"))
    return up.join(dirs, "dir").groupBy("path").agg(F.max_by("package", "depth").alias("package"))


def public_api(functions: DataFrame, calls: DataFrame, k: int = 4) -> DataFrame:
    """Per package its public functions most called from other packages, names once.

    functions: (id, name, ord, package, is_pub); calls: (source, target).
    """
    one = functions.select(F.col("id").alias("source"), F.col("package").alias("from"))
    outside = calls.select("source", "target").join(one, "source").join(functions.where("is_pub").select(F.col("id").alias("target"), "name", "ord", "package"), "target").where("from <> package")
    ranked = outside.groupBy("package", "name").agg(F.count("*").alias("callers"), F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("callers"), "ord"))
    return ranked.withColumn("place", place).where(F.col("place") <= k).select("package", "place", "name", "callers")


def artifact_users(edges: DataFrame) -> DataFrame:
    """A row per data file and user: whether the user writes it, whether it reads it."""
    return artifact_pairs(edges).drop("ord")


def artifact_pairs(edges: DataFrame) -> DataFrame:
    """`artifact_users` with the first place (`ord`) among the edges, null where they have none."""
    # A user mostly has one edge to a file: a grouping within the tasks before would hold nearly every edge in memory.
    io = dealt(edges.where("relation IN ('Writes', 'Reads')"), "target", "source")
    ord_ = F.col("ord") if "ord" in edges.columns else F.lit(None).cast("bigint")
    return io.groupBy(F.col("target").alias("artifact"), F.col("source").alias("user")).agg(F.min(ord_).alias("ord"), F.bool_or(F.col("relation") == "Writes").alias("writes"), F.bool_or(F.col("relation") == "Reads").alias("reads"))


def artifact_ranking(edges: DataFrame, k: int = 10) -> DataFrame:
    """Data files with both writers and readers first, then by users, then by name."""
    return ranked_artifacts(artifact_users(edges), k)


def ranked_artifacts(users: DataFrame, k: int = 10) -> DataFrame:
    """The same from `artifact_users`."""
    both = F.bool_or("writes") & F.bool_or("reads")
    io = users.groupBy("artifact").agg(both.alias("two_way"), F.count("user").alias("users"))
    return io.orderBy(F.desc("two_way"), F.desc("users"), "artifact").limit(k).select("artifact", "two_way", "users")


def shown_users(edges: DataFrame, k: int = 4) -> DataFrame:
    """The first users of every data file, and how many more there are."""
    return first_users(durable(artifact_pairs(edges).select("artifact", "user", "ord"), "users"), k)


def first_users(pairs: DataFrame, k: int = 4) -> DataFrame:
    """The same from written `artifact_pairs`.

    Users are counted by an aggregate and the first ones taken by a ranking that keeps k rows per task
    before it shuffles, so a file that everyone uses is no task of its own.
    """
    shown = pairs.withColumn("place", F.row_number().over(Window.partitionBy("artifact").orderBy("ord", "user"))).where(F.col("place") <= k)
    more = pairs.groupBy("artifact").agg(F.greatest(F.count("*") - k, F.lit(0)).alias("hidden"))
    return shown.join(more, "artifact").select("artifact", "place", "user", "hidden")


def heaviest_outgoing(links: DataFrame) -> DataFrame:
    """Per box its heaviest link; of equal ones the smallest target."""
    w = Window.partitionBy("from").orderBy(F.desc("count"), "to")
    return links.withColumn("place", F.row_number().over(w)).where("place = 1").select("from", "to", "count")


def cross_package_callers(calls: DataFrame, package_of: DataFrame, k: int = 10) -> DataFrame:
    """One caller from another package per called function, the earliest edge; the first k edges."""
    one = package_of.select(F.col("id").alias("source"), F.col("package").alias("from"))
    two = package_of.select(F.col("id").alias("target"), F.col("package").alias("to"))
    rows = calls.join(one, "source").join(two, "target").where(F.col("from") != F.col("to"))
    first = rows.groupBy("target").agg(F.min_by(F.struct("source", "ord"), "ord").alias("x")).select("target", "x.source", "x.ord")
    return first.orderBy("ord").limit(k)


def legend(nodes: DataFrame, role: str = "role") -> DataFrame:
    """Counts in the fixed order of roles."""
    place = F.array_position(F.array(*[F.lit(r) for r in L.ROLE_ORDER]), F.col(role))
    return nodes.groupBy(F.col(role).alias("role"), place.alias("place")).agg(F.count("*").alias("n"))


def merged_links(links: DataFrame) -> DataFrame:
    """Package links once per pair: the largest weight, optional only if every one is."""
    return links.where("from <> to").groupBy("from", "to").agg(F.max("weight").alias("weight"), F.bool_and("optional").alias("optional"))
