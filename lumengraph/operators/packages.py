"""The package level: manifests to dependencies, roll-ups of files to packages, and the cut of a package diagram.

Manifests come as flat specs (`cargo:` imports of their files). Every lookup is an equi-join: a
package meets its workspace over its ancestors, a dependency its target over the target's folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.operators import rollup
from lumengraph.runtime import durable

MOST_PACKAGES, LINES_A_POINT = 48, 400


def specs(imports: DataFrame) -> DataFrame:
    """Manifest lines (path, dir, pos, what, a, b, c, d, rest) of `imports(file_id, pos, spec)`."""
    cut = F.split(F.expr("substring(spec, 7)"), r"\|", 6)
    rows = imports.where(F.col("spec").startswith("cargo:")).select(P.norm(F.expr("substring(file_id, 6)")).alias("path"), "pos", *[F.get(cut, F.lit(k)).alias(n) for k, n in enumerate(("what", "a", "b", "c", "d", "rest"))])
    return rows.withColumn("dir", P.directory(F.col("path")))


def declared(rows: DataFrame) -> DataFrame:
    """Packages: path, dir, name, bins (named ones), code_name."""
    code = F.coalesce(F.nullif("rest", F.lit("")), F.replace("a", F.lit("-"), F.lit("_")))
    return rows.where("what = 'package' AND a <> ''").select("path", "dir", F.col("a").alias("name"), (F.col("c") != "").alias("bins"), code.alias("code_name"))


def homes(rows: DataFrame) -> DataFrame:
    """(path, home) per package: the nearest folder at or above its own, the tree's top included, that is a workspace, else its own."""
    spaces = rows.where("what = 'package' AND d = '1'").select("dir").distinct()
    own = declared(rows).select("path", F.col("dir").alias("own"))
    up = own.select("path", F.posexplode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path")))).alias("depth", "dir")).join(spaces, "dir")
    nearest = up.groupBy("path").agg(F.max_by("dir", "depth").alias("nearest"))
    return own.join(nearest, "path", "left").select("path", F.coalesce("nearest", "own").alias("home"))


def links(rows: DataFrame) -> DataFrame:
    """Dependencies between packages: path (whose), pos, name, at (the folder meant), to (its manifest, null outside), repo, optional.

    A path of its own counts from the package, one of the workspace from the workspace. Development
    and registry dependencies go, and so do links to oneself.
    """
    packages = declared(rows).select("path", F.col("dir").alias("own")).join(homes(rows), "path")
    asked = rows.where("what = 'dep' AND d <> '1'").select("path", "pos", F.col("a").alias("name"), F.nullif("rest", F.lit("")).alias("rel"), (F.col("b") == "1").alias("shares"), (F.col("c") == "1").alias("optional"))
    shared = rows.where("what = 'shared'").groupBy(F.col("dir").alias("home"), F.col("a").alias("name")).agg(F.min_by("rest", "pos").alias("shared"))
    at = asked.join(packages, "path").join(shared, ["home", "name"], "left")
    meant = F.when(F.col("rel").isNotNull(), P.join_norm(F.col("own"), F.col("rel"))).when(F.col("shares") & F.col("shared").isNotNull(), P.join_norm(F.col("home"), F.col("shared")))
    found = at.withColumn("at", meant).where("at IS NOT NULL")
    targets = declared(rows).groupBy(F.col("dir").alias("at")).agg(F.max("path").alias("to"))
    found = found.join(targets, "at", "left").where("to IS NULL OR to <> path")
    return found.select("path", "pos", "name", "at", "to", P.sibling_repo(F.col("own"), F.col("at")).alias("repo"), "optional")


def outside_id(repo, name):  # noqa: ANN001, ANN201
    return F.concat(F.lit("ext:"), repo, F.lit("/"), name)


def depends_on(nodes: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, relation, confidence) between packages, and the nodes of those outside.

    A pair is one edge: 1.0 if any of its dependencies is required, 0.5 if all are optional. If a
    package has no node there are no edges at all.
    """
    rows = durable(specs(imports), "manifests")
    known = nodes.where("kind = 'Crate'").groupBy(P.norm(F.col("path")).alias("path")).agg(F.min("id").alias("id"))
    found = links(rows)
    if not declared(rows).join(known, "path", "left_anti").isEmpty():
        found = found.limit(0)
    own, other = known.withColumnRenamed("id", "source"), known.select(F.col("path").alias("to"), F.col("id").alias("inside"))
    target = F.coalesce("inside", outside_id(F.col("repo"), F.col("name")))
    ends = durable(found.join(own, "path").join(other, "to", "left").withColumn("target", target), "package_links")
    edges = ends.groupBy("source", "target").agg(F.max(F.when(F.col("optional"), 0.5).otherwise(1.0)).alias("confidence"))
    far = ends.where("inside IS NULL").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("path", "pos", "at", "name", "repo")).alias("x"))
    far = far.select("id", F.col("x.at").alias("path"), F.col("x.name").alias("name"), F.lit("ExternalCrate").alias("kind"), F.col("x.repo").alias("search_body"))
    return edges.select("source", "target", F.lit("DependsOn").alias("relation"), "confidence"), far


def direct(edges: DataFrame) -> DataFrame:
    """(package, other_package) of required and optional dependencies inside the tree."""
    return edges.where((F.col("relation") == "DependsOn") & ~F.col("target").startswith("ext:")).select(F.col("source").alias("package"), F.col("target").alias("other_package")).distinct()


def _file_owners(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id, file, package) of product files."""
    files = nodes.where("kind = 'File'").select(F.col("id").alias("file_id"), P.norm(F.col("path")).alias("path")).where(P.in_product(F.col("path")))
    owners = rollup.owners(files.select("path").distinct(), packages.select(F.col("path").alias("id"), "dir", F.lit(0).alias("ord")))
    return files.join(owners, "path").select("file_id", F.col("path").alias("file"), "package")


def lines_of(owners: DataFrame, facts: DataFrame) -> DataFrame:
    """(package, lines): Rust lines from `loc` facts, summed per package."""
    rows = facts.where("tag = 'loc'").join(owners.where(F.col("file").endswith(".rs")), F.col("node_id") == F.col("file_id"))
    return rows.groupBy("package").agg(F.sum(F.expr("try_cast(value AS BIGINT)")).alias("lines"))


def _targets(nodes: DataFrame) -> DataFrame:
    """(dir, lib, main): folders below which a library root, or a program, lies."""
    files = nodes.where("kind = 'File'").select(P.norm(F.col("path")).alias("path"))
    roots = files.select(F.regexp_extract("path", r"^(.*)/src/(?:lib|main)\.rs$", 1).alias("dir"), F.col("path").endswith("/lib.rs").alias("lib")).where("dir <> ''")
    bins = files.select(F.explode(P.ancestors(F.col("path"))).alias("up")).where(F.col("up").endswith("/src/bin")).select(F.expr("left(up, length(up) - 8)").alias("dir"), F.lit(False).alias("lib"))
    return roots.union(bins).groupBy("dir").agg(F.bool_or("lib").alias("lib"), F.bool_or(~F.col("lib")).alias("main"))


def api_names(nodes: DataFrame, edges: DataFrame, facts: DataFrame, owners: DataFrame, k: int = 4) -> DataFrame:
    """(package, api): names of the public functions most called from other packages, then by name."""
    fns = nodes.where("kind IN ('Function', 'Method')").join(owners, F.concat(F.lit("file:"), "path") == F.col("file_id")).select("id", "name", "kind", "package")
    ends = fns.select("id", "package")
    calls = edges.where("relation = 'Calls'").join(ends.withColumnsRenamed({"id": "source", "package": "from"}), "source").join(ends.withColumnsRenamed({"id": "target", "package": "to"}), "target")
    outside = calls.where(F.col("from") != F.col("to")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"))
    public = fns.where("kind = 'Function'").join(facts.where("tag = 'pub'").select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    named = public.join(outside, "id", "left").select("package", "name", F.coalesce("callers", F.lit(0)).alias("callers")).distinct()
    place = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("callers"), "name"))
    first = named.withColumn("place", place).where(F.col("place") <= k)
    return first.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("api"))


def summary(nodes: DataFrame, edges: DataFrame, imports: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (key, ord, id, label, box, external, lines, bin, lib, role, api, dir) and links (from, to, uses, optional).

    Manifests below test folders count for nothing. Keys of boxes are manifests, or ids of outside packages.
    """
    rows = durable(specs(imports).where(P.in_product(F.col("path"))), "manifests")
    own, found = durable(declared(rows), "packages"), links(rows)
    found = durable(found.withColumn("key", F.coalesce("to", outside_id(F.col("repo"), F.col("name")))), "links")
    owners = durable(_file_owners(nodes, own), "owners")
    needs = rows.where("what = 'dep'").groupBy("path").agg(F.collect_set("a").alias("deps"))
    used = found.where("to IS NOT NULL").select(F.col("to").alias("path"), F.lit(True).alias("used")).distinct()
    boxes = own.join(homes(rows), "path").join(needs, "path", "left").join(used, "path", "left").join(_targets(nodes), "dir", "left")
    boxes = boxes.join(lines_of(owners, facts).withColumnRenamed("package", "path"), "path", "left").join(api_names(nodes, edges, facts, owners).withColumnRenamed("package", "path"), "path", "left")
    lib, program = F.coalesce("lib", F.lit(False)), F.col("bins") | F.coalesce("main", F.lit(False))
    none = F.array().cast("array<string>")
    role = L.role_for_package(F.col("name"), F.coalesce("deps", none), program & ~lib, F.coalesce("used", F.lit(False)))
    inside = boxes.select(
        F.col("path").alias("key"), F.struct(F.lit(0).alias("o"), F.col("path").alias("p"), F.lit(0).alias("n")).alias("ord"), F.col("name").alias("id"), F.col("name").alias("label"), P.file_name(F.col("home")).alias("box"),
        F.lit(False).alias("external"), F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"), program.alias("bin"), lib.alias("lib"), role.alias("role"), F.coalesce("api", none).alias("api"), "dir", "code_name",
    )
    far = found.where("to IS NULL").groupBy("key").agg(F.min(F.struct(F.lit(1).alias("o"), F.col("path").alias("p"), F.col("pos").alias("n"))).alias("ord"), F.min(F.struct("name", "repo")).alias("x"))
    outside = far.select(
        "key", "ord", F.col("key").alias("id"), F.col("x.name").alias("label"), F.col("x.repo").alias("box"), F.lit(True).alias("external"), F.lit(0).cast("bigint").alias("lines"), F.lit(False).alias("bin"), F.lit(True).alias("lib"),
        F.lit("External").alias("role"), none.alias("api"), F.lit("").alias("dir"), F.replace("x.name", F.lit("-"), F.lit("_")).alias("code_name"),
    )
    every = durable(inside.unionByName(outside), "boxes")
    pairs = found.groupBy(F.col("path").alias("from"), F.col("key").alias("to")).agg(F.bool_and("optional").alias("optional"))
    # The first box with a code name is the one that a path starting so means.
    named = every.groupBy(F.col("code_name").alias("head")).agg(F.min_by("key", "ord").alias("to"))
    paths = imports.where(F.col("spec").startswith("rs:")).select("file_id", F.substring_index(F.expr("substring(spec, 4)"), "::", 1).alias("head")).join(owners, "file_id")
    uses = paths.groupBy(F.col("package").alias("from"), "head").agg(F.count("*").alias("n")).join(named, "head").groupBy("from", "to").agg(F.sum("n").alias("uses"))
    linked = pairs.join(uses, ["from", "to"], "left").select("from", "to", F.coalesce("uses", F.lit(0)).alias("uses"), "optional")
    return every.drop("code_name"), durable(linked, "uses")


def top_boxes(boxes: DataFrame, linked: DataFrame, k: int = MOST_PACKAGES) -> DataFrame:
    """(key, score) of the boxes that a diagram shows: twice the uses and links at either end, and a point per 400 lines."""
    ends = rollup.weighted_degree(linked, weight=F.col("uses") + 1)
    score = F.coalesce("degree", F.lit(0)) * 2 + F.floor(F.col("lines") / LINES_A_POINT)
    return boxes.join(ends, "key", "left").select("key", score.cast("bigint").alias("score"), "ord").orderBy(F.desc("score"), "ord").limit(k).select("key", "score")
