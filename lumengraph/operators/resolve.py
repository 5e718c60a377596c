"""Entity resolution: prioritized equi-joins where a tier decides only with exactly one candidate.

A tier is a set of key columns. Definitions are counted per key before they are joined, so a name
that thousands define costs one row per key and not one per candidate.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Method names so common that a call by them says nothing.
STD_METHODS = (
    "new default from into clone len push pop get insert remove contains iter next map unwrap expect is_empty fmt as_str to_string eq cmp partial_cmp "
    "path id name join send recv lock read write open close run build parse take set add sub drop deref hash borrow "
    "as_ref as_mut to_owned extend clear first last find filter collect flush kind key value keys values or_default entry and_then ok err min max sort rev"
).split()


@dataclass
class Tier:
    """Definitions that match a call on `keys` are candidates of this tier.

    via: (left, right) pairs to go through between the call's column and the definition's, with the
    call's column and the definition's column that they replace.
    """

    keys: tuple[str, ...]
    confidence: float
    via: DataFrame | None = None
    over: tuple[str, str] = ("", "")
    own_too: bool = False
    definitions: DataFrame | None = None
    #: Calls in another form (names and files that a binding stands for), in place of all calls.
    calls: DataFrame | None = None


@dataclass
class Rules:
    tiers: list[Tier]
    #: Names that stop the search after this many tiers.
    stop_after: int = 0
    stop_names: list[str] = field(default_factory=list)


def resolve(calls: DataFrame, definitions: DataFrame, rules: Rules) -> DataFrame:
    """(caller, tok_ord, target, confidence) of the first tier with exactly one candidate.

    calls: caller, tok_ord, name and the key columns; definitions: id, name and the key columns.

    What a tier finds hangs on a call's name and keys alone. So each such set is looked up once, also where it
    goes through pairs, and calls meet their answers by all of it: no task gets all the calls of one file.
    """
    asked: list[tuple[DataFrame, dict[int, Tier]]] = []  # calls of one form, with their tiers by number
    for number, tier in enumerate(rules.tiers):
        mine = calls if tier.calls is None else tier.calls
        same = next((tiers for form, tiers in asked if form is mine), None)
        if same is None:
            asked.append((mine, same := {}))
        same[number] = tier
    hits = None
    for mine, tiers in asked:
        keys = ["name", *dict.fromkeys(k for tier in tiers.values() for k in tier.keys)]
        wanted = mine.select(*keys).distinct()
        answers = None
        for number, tier in tiers.items():
            defs = tier.definitions if tier.definitions is not None else definitions
            few = wanted.where(~F.col("name").isin(rules.stop_names)) if rules.stop_names and number >= rules.stop_after else wanted
            found = _candidates(few, defs, tier).join(few, ["name", *tier.keys]).select(*keys, F.lit(number).alias("tier"), "n", "target")
            answers = found if answers is None else answers.union(found)
        # One row for each set, tiers in a list: a set with a null key has no row for the tiers that need it.
        answers = answers.groupBy(*keys).agg(F.collect_list(F.struct("tier", "n", "target")).alias("found")).select(*[F.col(k).alias(f"_{k}") for k in keys], "found")
        met = mine.select("caller", "tok_ord", *keys).join(answers, _all(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)).select("caller", "tok_ord", "found")
        hits = met if hits is None else hits.union(met)
    # A call may stand in several rows and forms: its candidates of a tier count together.
    of = lambda number: F.filter("found", lambda x: x["tier"] == number)
    many = hits.select("caller", "tok_ord", *[F.get(of(number), 0).alias(f"t{number}") for number in range(len(rules.tiers))])
    per = many.groupBy("caller", "tok_ord").agg(*[F.struct(F.sum(f"t{k}.n").alias("n"), F.min(f"t{k}.target").alias("target")).alias(f"t{k}") for k in range(len(rules.tiers))])
    best = F.coalesce(*[F.when(F.col(f"t{k}.n") == 1, F.struct(F.col(f"t{k}.target"), F.lit(tier.confidence).alias("confidence"))) for k, tier in enumerate(rules.tiers)])
    return per.select("caller", "tok_ord", best.alias("x")).where("x IS NOT NULL").select("caller", "tok_ord", "x.target", "x.confidence")


def _all(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _candidates(wanted: DataFrame, definitions: DataFrame, tier: Tier) -> DataFrame:
    """(name, keys, n, target): how many definitions a tier finds for each wanted name and keys, and the first."""
    if tier.via is None:
        return definitions.groupBy("name", *tier.keys).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    column, other = tier.over
    rest = [k for k in tier.keys if k != column]
    per = definitions.groupBy("name", *rest, F.col(column).alias(other)).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    wanted = wanted.select("name", *tier.keys).distinct()
    pairs = tier.via.distinct()
    if tier.own_too:
        pairs = pairs.union(wanted.select(F.col(column), F.col(column).alias(other)).distinct()).distinct()
    return wanted.join(pairs, column).join(per, ["name", *rest, other]).groupBy("name", *tier.keys).agg(F.sum("n").alias("n"), F.min("target").alias("target"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges (source, target, confidence, tok_ord): no self edges, each pair once by its first token."""
    real = resolved.where("caller <> target")
    return real.groupBy(F.col("caller").alias("source"), "target").agg(F.min_by("confidence", "tok_ord").alias("confidence"), F.min("tok_ord").alias("tok_ord"))


def free_function_rules(imports: DataFrame, package_deps: DataFrame, free: DataFrame) -> Rules:
    """Plain names: own file 0.95, files in scope 0.90, own package 0.75, public in a direct dependency 0.60.

    imports: (file, other_file); package_deps: (package, other_package).
    """
    return Rules([
        Tier(("file",), 0.95),
        Tier(("file",), 0.90, imports, ("file", "other_file"), True),
        Tier(("package",), 0.75),
        Tier(("package",), 0.60, package_deps, ("package", "other_package"), False, free.where("is_pub")),
    ])


def method_rules(imports: DataFrame) -> Rules:
    """`.name`: own type in the file 0.85, then (unless the name is a common one) file 0.70, scope 0.65, package 0.55."""
    return Rules([
        Tier(("file", "owner"), 0.85),
        Tier(("file",), 0.70),
        Tier(("file",), 0.65, imports, ("file", "other_file"), True),
        Tier(("package",), 0.55),
    ], 1, STD_METHODS)


def typed_rules(imports: DataFrame) -> Rules:
    """`Type::name`: by owner in the file, in scope, in the package, all 0.85."""
    return Rules([
        Tier(("file", "owner"), 0.85),
        Tier(("file", "owner"), 0.85, imports, ("file", "other_file"), True),
        Tier(("package", "owner"), 0.85),
    ])


def resolve_rust(calls: DataFrame, definitions: DataFrame, imports: DataFrame, package_deps: DataFrame, module_files: DataFrame) -> DataFrame:
    """Call edges of all Rust tokens.

    calls: caller, tok_ord, token, file, package, owner (of the caller). definitions: id, name,
    file, package, owner, is_pub. module_files: (file, qualifier, other_file), what a module path
    means in a file, as `module_files` gives it.
    """
    calls = calls.withColumn("package", F.coalesce("package", F.lit("")))
    definitions = definitions.withColumn("package", F.coalesce("package", F.lit("")))
    free, methods = definitions.where("owner IS NULL"), definitions.where("owner IS NOT NULL")
    dot = calls.where(F.col("token").startswith(".")).withColumn("name", F.expr("substring(token, 2)"))
    path = calls.where(~F.col("token").startswith(".") & F.contains("token", F.lit("::"))).withColumn("name", F.substring_index("token", "::", -1))
    path = path.withColumn("qualifier", F.expr("substring(token, 1, length(token) - length(name) - 2)")).withColumn("last", F.substring_index("qualifier", "::", -1))
    plain = calls.where(~F.col("token").startswith(".") & ~F.contains("token", F.lit("::"))).withColumn("name", F.col("token"))
    is_type = F.col("last").rlike(r"^\p{Lu}")
    typed = path.where(is_type).withColumn("owner", F.when(F.col("last") == "Self", F.col("owner")).otherwise(F.col("last")))
    module = path.where(~is_type).join(module_files.distinct(), ["file", "qualifier"]).withColumn("file", F.col("other_file"))
    found = (
        resolve(dot, methods, method_rules(imports))
        .union(resolve(typed, methods, typed_rules(imports)))
        .union(resolve(module, free, Rules([Tier(("file",), 0.95)])))
        .union(resolve(plain, free, free_function_rules(imports, package_deps, free)))
    )
    return call_edges(found)


def qualifiers(calls: DataFrame) -> DataFrame:
    """(file, qualifier) of tokens `a::b::name` whose last qualifier is no type."""
    path = calls.where(~F.col("token").startswith(".") & F.contains("token", F.lit("::")))
    cut = F.split("token", "::")
    rows = path.select("file", F.array_join(F.slice(cut, F.lit(1), F.size(cut) - 1), "::").alias("qualifier"))
    return rows.where(~F.substring_index("qualifier", "::", -1).rlike(r"^\p{Lu}")).distinct()


def module_files(wanted: DataFrame, resolved: DataFrame, imported: DataFrame) -> DataFrame:
    """(file, qualifier, other_file): the file a module path leads to, else the imported module that its first name names.

    wanted: (file, qualifier); resolved: (file, spec, other_file) of the paths that lead to a file;
    imported: (file, module, other_file). Of several modules of a name the first path counts.
    """
    found = resolved.select("file", F.col("spec").alias("qualifier"), "other_file")
    rest = wanted.join(found, ["file", "qualifier"], "left_anti").withColumn("module", F.substring_index("qualifier", "::", 1))
    named = imported.groupBy("file", "module").agg(F.min("other_file").alias("other_file"))
    return wanted.join(found, ["file", "qualifier"]).select("file", "qualifier", "other_file").union(rest.join(named, ["file", "module"]).select("file", "qualifier", "other_file"))


def unique_name(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (caller, tok_ord, name) whose name has exactly one definition anywhere."""
    return resolve(calls, definitions, Rules([Tier((), 1.0)]))


def ordered_candidates(wanted: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): of a spec's ordered candidate paths the first that exists.

    wanted: (id, ...); candidates: (id, rank, path); files: (path).
    """
    hits = candidates.join(files.select("path").distinct(), "path")
    return wanted.select("id").join(hits.groupBy("id").agg(F.min_by("path", "rank").alias("path")), "id")


def unique_suffix(specs: DataFrame, files: DataFrame, most_parts: int = 5) -> DataFrame:
    """(id, path): dotted specs that are the tail of exactly one file's dotted path.

    Tails of up to `most_parts` segments are listed per file and met by equality.
    """
    dotted = F.split(F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), "/__init__$", ""), "/")
    tails = files.select("path", dotted.alias("p")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(most_parts))), lambda n: F.concat_ws(".", F.slice("p", -n, n)))).alias("tail"))
    one = tails.groupBy("tail").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1")
    return specs.join(one, specs["spec"] == one["tail"]).select("id", "path")


def package_links(packages: DataFrame, deps: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Resolved package dependencies: from, target_kind, to, weight.

    packages: (id, name, dir); deps: (id, name, path_dir, from_workspace, optional, dev);
    workspaces: (dir, name, path_dir, owner). Dev and registry dependencies go, links to oneself go; a
    path that no package has is an external one, named by its folder.
    """
    real = deps.where(~F.col("dev"))
    shared = workspaces.select(F.col("owner").alias("id"), "name", F.col("path_dir").alias("shared_dir"))
    at = real.join(shared, ["id", "name"], "left").withColumn("dir", F.coalesce("path_dir", F.when(F.col("from_workspace"), F.col("shared_dir"))))
    at = at.where("dir IS NOT NULL")
    home = packages.select(F.col("id").alias("to"), "dir")
    rows = at.join(home, "dir", "left").select(F.col("id").alias("from"), F.when(F.col("to").isNull(), "external").otherwise("local").alias("target_kind"), F.coalesce("to", F.concat(F.lit("ext:"), "dir")).alias("to"), F.when(F.col("optional"), 0.5).otherwise(1.0).alias("weight"))
    return rows.where("from <> to").groupBy("from", "target_kind", "to").agg(F.max("weight").alias("weight"))


def artifact_flow(functions: DataFrame, io: DataFrame, names: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges between functions and data files: source, target, relation, confidence.

    A function that reads or writes is tied to the files it names, or, if it names none, to those
    that the functions it calls directly name. functions: (id); io: (id, op); names: (id, artifact).
    """
    own = io.join(names, "id")
    silent = io.join(names.select("id").distinct(), "id", "left_anti")
    lent = silent.join(calls.select(F.col("source").alias("id"), F.col("target").alias("callee")), "id").join(names.withColumnRenamed("id", "callee"), "callee").select("id", "op", "artifact")
    relation = F.when(F.col("op") == "r", "Reads").otherwise("Writes")
    rows = own.select("id", "op", "artifact").union(lent).join(functions.select("id"), "id", "left_semi")
    return rows.select(F.col("id").alias("source"), F.concat(F.lit("artifact:"), "artifact").alias("target"), relation.alias("relation"), F.lit(0.9).alias("confidence")).distinct()


def use_counts(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """(from, to, uses): import paths whose first segment is the code name of a declared dependency.

    imports: (package, spec); declared: (from, to, code_name).
    """
    head = F.regexp_extract("spec", r"^([A-Za-z0-9_]+)", 1)
    used = imports.select(F.col("package").alias("from"), head.alias("code_name"))
    first = declared.groupBy("from", "code_name").agg(F.min("to").alias("to"))
    return declared.join(used.join(first, ["from", "code_name"]).groupBy("from", "to").agg(F.count("*").alias("uses")), ["from", "to"], "left").select("from", "to", F.coalesce("uses", F.lit(0)).alias("uses"))
