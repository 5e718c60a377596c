"""Path functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are no architecture, that hold packages, and that hold sources.
SKIPPED_DIRS = ("tests", "test", "benches", "examples", "target", "node_modules", "docs", "fixtures", "dist", "build")
CONTAINER_DIRS = ("crates", "packages", "apps", "libs", "services", "modules", "cmd")
SOURCE_DIRS = ("src", "lib", "app", "source")
UNSHIPPED_DIRS = ("tests", "benches", "examples", "fixtures")


def norm(path: Column) -> Column:
    """Forward slashes only."""
    return F.translate(path, "\\", "/")


def parts(path: Column) -> Column:
    """Segments without empty ones and dots."""
    return F.filter(F.split(norm(path), "/"), lambda p: (p != "") & (p != "."))


def directory(path: Column) -> Column:
    return F.regexp_extract(norm(path), r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(norm(path), r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    """A name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """File stem; a `mod` file is named by its folder."""
    name = stem(file_name(path))
    return F.when(name == "mod", file_name(directory(path))).otherwise(name)


def base_name(name: Column) -> Column:
    """What comes before generic parameters."""
    return F.substring_index(name, "<", 1)


def join_norm(base: Column, spec: Column) -> Column:
    """`spec` taken from `base`, with dots folded; climbing above the top stays at the top, and a leading slash stays."""
    steps = F.concat(F.split(norm(base), "/"), F.split(norm(spec), "/"))
    none = F.array().cast("array<string>")

    def step(found: Column, p: Column) -> Column:
        up = F.when(F.size(found) > 0, F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
        return F.when((p == "") | (p == "."), found).when(p == "..", up).otherwise(F.concat(found, F.array(p)))

    return F.concat(F.when(base.startswith("/"), "/").otherwise(""), F.concat_ws("/", F.aggregate(steps, none, step)))


def ancestors(path: Column) -> Column:
    """Every directory above a path, deepest last; the top is not among them."""
    p = F.split(norm(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda n: F.concat_ws("/", F.slice(p, F.lit(1), n)))


def has_source_dir(name: Column) -> Column:
    return name.isin(*SOURCE_DIRS)


def locate(path: Column, prefix: Column, root: Column) -> Column:
    """Struct (region, module) of a source file below `prefix` leading segments, or null for no architecture."""
    below = F.slice(parts(path), prefix + 1, F.greatest(F.size(parts(path)) - prefix, F.lit(0)))
    dirs = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
    file = F.element_at(below, -1)
    first, second = F.get(dirs, F.lit(0)), F.get(dirs, F.lit(1))
    tail = lambda n: F.slice(dirs, F.lit(n + 1), F.greatest(F.size(dirs) - n, F.lit(0)))
    contained = first.isin(*CONTAINER_DIRS) & second.isNotNull()
    region = F.when(F.size(dirs) == 0, root).when(contained, second).when(has_source_dir(first), root).otherwise(first)
    rest = F.when(F.size(dirs) == 0, dirs).when(contained, tail(2)).otherwise(tail(1))
    lead = F.get(rest, F.lit(0))
    rest = F.when(has_source_dir(lead), F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    module = F.coalesce(F.get(rest, F.lit(0)), stem(file))
    skipped = F.exists(dirs, lambda d: F.lower(d).isin(*SKIPPED_DIRS)) | ((F.size(rest) == 0) & (stem(file) == "tests"))
    return F.when((F.size(below) > 0) & ~skipped, F.struct(region.alias("region"), module.alias("module")))


def rust_module(path: Column) -> Column:
    """Struct (root, module) around the last source folder of a Rust file: `a/src/b/c.rs` is (a, b::c)."""
    whole = r"^(?:(.*)/)?src/(.*)\.rs$"
    inner = F.regexp_replace(F.regexp_extract(norm(path), whole, 2), r"/mod$", "")
    inner = F.when(inner.isin("lib", "main"), "").otherwise(F.replace(inner, F.lit("/"), F.lit("::")))
    return F.when(norm(path).rlike(whole), F.struct(F.regexp_extract(norm(path), whole, 1).alias("root"), inner.alias("module")))


def sibling_repo(base: Column, other: Column) -> Column:
    """The first segment of `other` that differs from the one of `base` at its place, else its last one."""
    a, b = parts(base), parts(other)
    at = F.filter(F.transform(b, lambda x, i: F.when(F.coalesce(F.get(a, i) != x, F.lit(True)), x)), lambda x: x.isNotNull())
    return F.coalesce(F.get(at, F.lit(0)), F.try_element_at(b, F.lit(-1)), F.lit(""))


def in_product(path: Column) -> Column:
    """Whether a path is part of the product that package roll-ups describe; a third rule beside the two of the extractors."""
    return ~F.exists(F.split(norm(path), "/"), lambda p: p.isin(*UNSHIPPED_DIRS))
