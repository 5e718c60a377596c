"""Imports and calls of the languages other than Rust: candidate files, bindings and their tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import paths as P
from lumengraph.operators import extract, resolve
from lumengraph.operators.resolve import Rules, Tier

# Endings tried on a relative script import, in order.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.mjs", "/index.cjs")
# The sources that a header stands for.
SOURCE_ENDINGS = ("c", "cpp", "cc", "cxx")
#: Languages whose files share names with their folder.
FOLDER_LANGUAGES = ("go", "java", "c")


def script_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file) of relative script specs: the first candidate that exists.

    specs: (file, spec); files: (path). Every candidate is one row and meets the files by equality.
    """
    base = P.join_norm(P.directory(F.col("file")), F.col("spec"))
    rows = specs.where(F.col("spec").startswith(".")).select("file", "spec", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS])).alias("rank", "path"))
    hits = rows.join(files.select("path").distinct(), "path")
    return hits.groupBy("file", "spec").agg(F.min_by("path", "rank").alias("other_file"))


def python_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file): relative specs climb one folder per dot after the first; others need one file alone that ends so."""
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    module = F.replace(F.expr("substring(spec, length(regexp_extract(spec, '^([.]*)', 1)) + 1)"), F.lit("."), F.lit("/"))
    near = specs.where(F.col("spec").startswith(".")).select("file", "spec", dots.alias("dots"), module.alias("module"), P.directory(F.col("file")).alias("dir"))
    parts = F.split("dir", "/")
    up = F.concat_ws("/", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("dots") + 1, F.lit(0))))
    names = F.when(F.col("module") == "", F.array(F.concat(up, F.lit("/__init__.py")))).otherwise(F.array(F.concat(up, F.lit("/"), "module", F.lit(".py")), F.concat(up, F.lit("/"), "module", F.lit("/__init__.py"))))
    hits = near.select("file", "spec", F.posexplode(names).alias("rank", "path")).join(files.select("path").distinct(), "path")
    relative = hits.groupBy("file", "spec").agg(F.min_by("path", "rank").alias("other_file"))
    far = specs.where(~F.col("spec").startswith("."))
    found = resolve.unique_suffix(far.select("spec").distinct().withColumn("id", F.col("spec")), files.where(F.col("path").endswith(".py")), most_parts=12)
    absolute = far.join(found.withColumnRenamed("id", "spec").withColumnRenamed("path", "other_file"), "spec").select("file", "spec", "other_file")
    return relative.union(absolute).where("file <> other_file")


def python_bindings(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file) of absolute dotted specs that are the tail, up to five names long, of one or two files."""
    p = F.split(F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), "/__init__$", ""), "/")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(5))), lambda n: F.concat_ws(".", F.slice(p, -n, n)))).alias("spec"))
    few = tails.groupBy("spec").agg(F.count("*").alias("n")).where("n <= 2").select("spec")
    return specs.where(~F.col("spec").startswith(".")).join(few, "spec").join(tails, "spec").select("file", "spec", F.col("path").alias("other_file"))


def _tails(path: Column, most: int) -> Column:
    """The last 1, 2, ... up to `most` segments of a path, joined."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(most))), lambda n: F.struct(n.alias("n"), F.concat_ws("/", F.slice(p, -n, n)).alias("tail")))


def go_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file): the files of the one folder that ends in the spec's last three, two or one segments.

    The longest tail that any folder has decides. One segment alone counts only for a spec of one
    segment or one that does not start with a host name. A folder above which nothing stands has no
    match: a tail starts after a slash.
    """
    code = files.select("path", P.directory(F.col("path")).alias("dir"))
    dirs = code.select("dir").distinct()
    below = F.filter(_tails(F.col("dir"), 3), lambda t: F.col("dir").endswith(F.concat(F.lit("/"), t["tail"])))
    listed = dirs.where("dir <> ''").select("dir", F.explode(below).alias("t")).groupBy("t.tail").agg(F.count("*").alias("dirs"), F.min("dir").alias("dir"))
    segments = F.filter(F.split("spec", "/"), lambda x: x != "")
    asked = specs.select("spec").distinct().select("spec", F.size(segments).alias("parts"), F.contains(F.get(segments, F.lit(0)), F.lit(".")).alias("host"), F.explode(_tails(F.col("spec"), 3)).alias("t"))
    hits = asked.join(listed, F.col("t.tail") == listed["tail"])
    best = hits.groupBy("spec").agg(F.max_by(F.struct("dirs", "dir", "t.n", "parts", "host"), "t.n").alias("x"))
    sure = best.where("x.dirs = 1 AND (x.n > 1 OR x.parts = 1 OR NOT x.host)").select("spec", "x.dir")
    return specs.join(sure, "spec").join(code, "dir").select("file", "spec", F.col("path").alias("other_file"))


def java_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file): the files of the named class, else all files of the package folder."""
    path = F.replace("spec", F.lit("."), F.lit("/"))
    asked = specs.select("spec").distinct().select("spec", path.alias("want"), F.substring_index("spec", ".", -1).alias("last"))
    named = files.select("path", P.file_name(F.col("path")).alias("name"))
    classes = asked.join(named, F.concat("last", F.lit(".java")) == F.col("name")).where(F.col("path").endswith(F.concat("want", F.lit(".java")))).select("spec", "path")
    rest = asked.join(classes.select("spec").distinct(), "spec", "left_anti")
    code = files.select("path", P.directory(F.col("path")).alias("dir")).withColumn("end", P.file_name(F.col("dir")))
    folders = rest.join(code, F.col("last") == F.col("end")).where(F.col("dir").endswith(F.concat(F.lit("/"), "want"))).select("spec", "path")
    return specs.join(classes.union(folders), "spec").select("file", "spec", F.col("path").alias("other_file"))


def c_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, spec, other_file): the header near the file, else every file whose path ends so, and the sources next to a header."""
    known = files.select("path").distinct()
    rows = specs.withColumn("near", P.join_norm(P.directory(F.col("file")), F.col("spec")))
    close = rows.join(known, F.col("near") == F.col("path")).select("file", "spec", "path")
    open_ones = rows.join(close.select("file", "spec"), ["file", "spec"], "left_anti").select("file", "spec", F.substring_index("spec", "/", -1).alias("name"))
    ending = known.withColumn("name", P.file_name(F.col("path")))
    far = open_ones.join(ending, "name").where(F.col("path").endswith(F.concat(F.lit("/"), "spec"))).select("file", "spec", "path")
    hits = close.union(far)
    stem = F.regexp_extract("path", r"^(.*)\.(?:h|hpp|hh)$", 1)
    beside = hits.withColumn("stem", stem).where("stem <> ''").select("file", "spec", F.explode(F.array(*[F.concat("stem", F.lit(f".{e}")) for e in SOURCE_ENDINGS])).alias("path")).join(known, "path").select("file", "spec", "path")
    return hits.union(beside).select("file", "spec", F.col("path").alias("other_file")).distinct()


def bindings(facts: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, local, original, other_file) of bindings whose spec was resolved, and (file, local) of the others.

    facts: (file, value) of `b:` facts; imports: (file, spec, other_file).
    """
    parts = F.split("value", r"\|", 3)
    rows = facts.select("file", F.get(parts, F.lit(0)).alias("local"), F.get(parts, F.lit(1)).alias("original"), F.get(parts, F.lit(2)).alias("spec"))
    known = rows.join(imports.select("file", "spec", "other_file"), ["file", "spec"])
    outside = rows.where("local <> '*'").join(imports.select("file", "spec"), ["file", "spec"], "left_anti")
    return known.select("file", "local", "original", "other_file"), outside.select("file", "local").distinct()


def resolve_other(calls: DataFrame, definitions: DataFrame, imports: DataFrame, bound: DataFrame, external: DataFrame) -> DataFrame:
    """Call edges of the tokens `name`, `recv.name`, `.name`, `~name` and `new:Name`.

    calls: caller, tok_ord, token, file, dir, lang, owner. definitions: id, name, kind, file, dir,
    owner, is_pub. imports: (file, other_file). bound and external as `bindings` gives them.
    """
    imports = imports.select("file", "other_file").distinct()
    classes = definitions.where(F.col("kind").isin("Class", "Interface", "Enum"))
    methods = definitions.where("owner IS NOT NULL AND kind = 'Method'")
    free = definitions.where("owner IS NULL AND kind = 'Function'")
    callable_ = definitions.where("kind <> 'Class'")
    keys = ["caller", "tok_ord", "name", "file", "dir", "owner"]

    def through(rows: DataFrame) -> DataFrame:
        """Calls as what their name is bound to: the original name in the other file."""
        hit = rows.join(bound.withColumnRenamed("local", "name"), ["file", "name"])
        return hit.select("caller", "tok_ord", F.when(F.col("original").isin("*", "default"), F.col("name")).otherwise(F.col("original")).alias("name"), F.col("other_file").alias("file"), "dir", "owner")

    token = F.col("token")
    made = calls.where(token.startswith("new:")).withColumn("name", F.expr("substring(token, 5)"))
    dotted = ~token.startswith(".") & ~token.startswith("~") & ~token.startswith("new:") & F.contains(token, F.lit("."))
    received = calls.where(dotted).withColumns({"receiver": F.substring_index("token", ".", 1), "name": F.substring_index("token", ".", -1)})
    plain = calls.where(~dotted & ~token.rlike("^(new:|[.~])")).withColumn("name", token)

    found = resolve.resolve(made.select(*keys), classes, Rules([
        Tier(("file",), 0.85), Tier(("file",), 0.85, calls=through(made)), Tier(("file",), 0.85, imports, ("file", "other_file"), True), Tier((), 0.85, definitions=classes.where("is_pub")),
    ]))
    # A class's constructor, where it has one, is what a `new` calls.
    builders = methods.where(F.col("name").isin("constructor", "__init__") | (F.col("name") == F.col("owner"))).groupBy("file", F.col("owner").alias("cls")).agg(F.min("id").alias("builder"))
    named = classes.select(F.col("id").alias("target"), "file", F.col("name").alias("cls")).join(builders, ["file", "cls"], "left")
    found = found.join(named, "target", "left").select("caller", "tok_ord", F.coalesce("builder", "target").alias("target"), "confidence")

    spaces = bound.select("file", F.col("local").alias("receiver"), "other_file").distinct()
    at_module = received.join(spaces, ["file", "receiver"]).select("caller", "tok_ord", "name", F.col("other_file").alias("file"))
    found = found.union(resolve.resolve(at_module, callable_, Rules([Tier(("file",), 0.90)])))
    loose = received.join(spaces, ["file", "receiver"], "left_anti").join(external.withColumnRenamed("local", "receiver"), ["file", "receiver"], "left_anti")
    loose = loose.where(~F.col("receiver").isin(*sorted(extract.STD_RECEIVERS)))
    typed = loose.where(F.col("receiver").rlike(r"^\p{Lu}")).withColumn("owner", F.col("receiver"))
    by_type = resolve.resolve(typed.select(*keys), methods, Rules([Tier(("owner",), 0.85)]))
    found = found.union(by_type)
    rest = loose.join(by_type.select("caller", "tok_ord"), ["caller", "tok_ord"], "left_anti").withColumn("owner", F.lit(None).cast("string"))
    unknown = rest.select(*keys, "lang").union(calls.where(token.startswith("~")).select("caller", "tok_ord", F.expr("substring(token, 2)").alias("name"), "file", "dir", F.lit(None).cast("string").alias("owner"), "lang"))
    unknown = unknown.union(calls.where(token.startswith(".")).select("caller", "tok_ord", F.expr("substring(token, 2)").alias("name"), "file", "dir", "owner", "lang"))
    unknown = unknown.where(~F.col("name").rlike("^__.*__$"))
    open_ = unknown.where(~F.col("name").isin(*sorted(extract.STD_METHODS)) & (F.octet_length("name") >= 4))
    found = found.union(resolve.resolve(unknown.select(*keys), methods, Rules([
        Tier(("file", "owner"), 0.85), Tier(("file",), 0.70, calls=open_), Tier(("file",), 0.60, imports, ("file", "other_file"), True, calls=open_), Tier(("dir",), 0.55, calls=open_.where(F.col("lang").isin(*FOLDER_LANGUAGES))),
    ])))

    inside = plain.join(external.withColumnRenamed("local", "name"), ["file", "name"], "left_anti")
    star = bound.where("local = '*'").select("file", "other_file").distinct()
    found = found.union(resolve.resolve(inside.select(*keys), free, Rules([
        Tier(("file",), 0.95), Tier(("file", "owner"), 0.95, definitions=methods), Tier(("file",), 0.90, calls=through(inside)), Tier(("file",), 0.85, star, ("file", "other_file")), Tier(("dir",), 0.75, calls=inside.where(F.col("lang").isin(*FOLDER_LANGUAGES))),
    ])))
    return resolve.call_edges(found)
