"""The façade: one object per source tree, and a line-based RPC server over it."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph import session
from lumengraph.functions import display as V
from lumengraph.functions import paths as P
from lumengraph.operators import delta, diagrams, extract, graph, grep, packages, resolve, rollup, search
from lumengraph.operators import imports as other
from lumengraph.runtime import durable
from lumengraph.sources import board, files, tree
from lumengraph.streaming import watch as W

#: The schema tag that a board may carry and still be green; deployments name their own.
BOARD_SCHEMA = "goals/1"
#: Rows of one reply; the methods themselves have no limit.
MOST_ROWS = 10_000


class Engine:
    """Queries over one indexed tree; `store` holds its tables."""

    def __init__(self, spark: SparkSession, root: str, store: str) -> None:
        self.spark, self.root, self.store = spark, root, store
        self._graph: tuple[DataFrame, DataFrame] | None = None
        self._words: search.Index | None = None

    def index(self) -> int:
        self._graph = self._words = None
        return W.index(self.spark, self.root, self.store)

    def watch(self, seconds: int = 5):  # noqa: ANN201
        return W.watch(self.spark, self.root, self.store, seconds)

    def tables(self) -> dict[str, DataFrame]:
        return extract.tables(W.rows(self.spark, self.store))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, resolved calls, data flow and document links among them."""
        if self._graph is None:
            self._graph = self._resolved()
        return self._graph

    def _resolved(self) -> tuple[DataFrame, DataFrame]:
        t = {name: durable(df, name) for name, df in self.tables().items()}
        nodes, facts = t["nodes"], t["facts"]
        owner = F.regexp_extract(F.expr("substring(id, length(path) + 2)"), r"^(.*)::[^:]*$", 1)
        fns = nodes.where(F.col("kind").isin("Function", "Method") & F.col("path").endswith(".rs")).select("id", P.base_name(F.col("name")).alias("name"), P.norm(F.col("path")).alias("file"), F.when(owner != "", owner).alias("owner"))
        pub = facts.where("tag = 'pub'").select(F.col("node_id").alias("id"), F.lit(True).alias("p")).distinct()
        named = packages.declared(packages.specs(t["imports"])).select("path", "code_name")
        crates = nodes.where("kind = 'Crate'").withColumn("path", P.norm(F.col("path"))).join(named, "path", "left").select("id", P.directory(F.col("path")).alias("dir"), F.col("ord"), "code_name")
        owners = rollup.owners(fns.select(F.col("file").alias("path")).distinct(), crates).withColumnRenamed("path", "file")
        fns = fns.join(pub, "id", "left").join(owners, "file", "left").withColumn("is_pub", F.coalesce("p", F.lit(False))).drop("p")
        imports = rust_imports(nodes, t["imports"], crates)
        calls = facts.where("tag = 'c'").join(fns, F.col("node_id") == F.col("id")).select(F.col("id").alias("caller"), F.col("pos").alias("tok_ord"), F.col("value").alias("token"), "file", "package", "owner")
        needed, far = packages.depends_on(nodes, t["imports"])
        needed = durable(needed, "depends_on")
        wanted = durable(resolve.qualifiers(calls), "qualifiers")
        led = module_paths(wanted.select("file", F.col("qualifier").alias("spec")), nodes, crates)
        modules = resolve.module_files(wanted, led, imports.select("file", P.module_name(F.col("other_file")).alias("module"), "other_file"))
        made = resolve.resolve_rust(calls, fns, imports.select("file", "other_file"), packages.direct(needed), modules).withColumn("relation", F.lit("Calls"))
        io = facts.where("tag = 'io'").select(F.col("node_id").alias("id"), F.col("value").alias("op"))
        names = facts.where("tag = 'a'").select(F.col("node_id").alias("id"), F.col("value").alias("artifact"))
        flow = resolve.artifact_flow(fns, io, names, made)
        shape = ["source", "target", "relation", "confidence"]
        files_linked = imports.select(F.concat(F.lit("file:"), "file").alias("source"), F.concat(F.lit("file:"), "other_file").alias("target"), F.lit("Imports").alias("relation"), F.lit(1.0).alias("confidence"))
        # What a token made is in the order of tokens; other edges of a node come before them.
        token = lambda df: F.col("tok_ord") if "tok_ord" in df.columns else F.lit(-1)
        edges = t["edges"].select(*shape, F.lit(-1).cast("bigint").alias("token"))
        for more in (made, files_linked, flow, needed, extract.ecosystem_links(nodes), *other_links(nodes, t["imports"], facts)):
            edges = edges.union(more.select(*shape, token(more).cast("bigint").alias("token")))
        place = nodes.select(F.col("id").alias("source"), "ord.path", "ord.pos").dropDuplicates(["source"])
        edges = edges.join(place, "source", "left").select(*shape, F.struct("path", "pos", "token", "target").alias("ord"))
        # Written once after each indexing: queries meet nodes and edges from several sides.
        nodes = nodes.unionByName(far, allowMissingColumns=True)
        return nodes, durable(edges, "graph_edges")

    def words(self) -> search.Index:
        """The index of all nodes' texts; they are cut once for all queries until the next indexing."""
        if self._words is None:
            docs = self.graph()[0].select("id", grep.indexed_text("name", "path", "search_body").alias("text"))
            self._words = search.stored(search.build_index(docs, "id", "text"))
        return self._words

    def register(self) -> None:
        """Makes the graph and its index part of the session's SQL (see `session`), as they are now."""
        session.register_search(self.spark, self.words())
        session.register_graph(self.spark, *self.graph())

    def ask(self, query: str, k: int = 10, alpha: float = 0.25, iterations: int = 25) -> DataFrame:
        """The k nodes closest to the best lexical hits."""
        nodes, edges = self.graph()
        terms = search.query_terms(self.spark, query)
        seeds = [(r.id, r.score) for r in search.bm25_indexed(self.words(), terms, 3 * k).collect()] if terms else []
        return graph.rank(nodes, edges, seeds, alpha, iterations).orderBy(F.desc("score"), "id").limit(k)

    def repo_map(self, max_dirs: int = 30) -> DataFrame:
        return graph.repo_map(*self.graph(), max_dirs)

    def grep(self, pattern: str, ignore_case: bool = False) -> DataFrame:
        """Matching lines of files."""
        nodes = self.tables()["nodes"].where("kind = 'File'")
        return grep.grep(nodes, "path", "file_residual", pattern, ignore_case)

    def declarations(self, pattern: str, ignore_case: bool = False) -> DataFrame:
        """Symbols whose declaration matches, with the references to each."""
        return grep.declarations(*self.graph(), pattern, ignore_case)

    def stats(self) -> DataFrame:
        """How many nodes, edges and languages of each kind there are."""
        nodes, edges = self.graph()
        tell = lambda what, df, column: graph.histogram(df, column).select(F.lit(what).alias("what"), F.col(column).alias("name"), "n")
        languages = nodes.where("kind = 'File'").select(files.language(F.col("path")).alias("language"))
        return tell("node", nodes, "kind").union(tell("edge", edges, "relation")).union(tell("language", languages.where("language IS NOT NULL"), "language"))

    def node(self, wanted: str) -> DataFrame:
        return graph.node(self.graph()[0], wanted)

    def skeleton(self, file: str) -> DataFrame:
        return grep.skeleton(self.tables()["nodes"], file)

    def trace(self, symbol: str) -> DataFrame:
        return grep.trace(self.graph()[1], symbol)

    def freshness(self, cached_at: str | None) -> DataFrame:
        return delta.stale(tree.listing(self.spark, self.root), F.lit(cached_at).cast("timestamp") if cached_at else None)

    def wiring(self) -> bytes:
        nodes, edges = self.graph()
        languages = nodes.select(files.language(F.col("path")).alias("l")).agg(F.array_sort(F.collect_set("l")).alias("l")).first().l
        return V.encode_wiring(1, nodes.count(), edges.count(), languages)

    def write_wiring(self, path: str) -> int:
        """Writes the wiring record to a file; returns its bytes."""
        data = self.wiring()
        with open(path, "wb") as f:
            f.write(data)
        return len(data)

    def packages(self) -> tuple[DataFrame, DataFrame]:
        """Package boxes and the links between them."""
        nodes, edges = self.graph()
        t = self.tables()
        return packages.summary(nodes, edges, t["imports"], t["facts"])

    def package_of(self) -> DataFrame:
        """(id, package) of all nodes with a path; the package is the one whose folder is the deepest above, else null."""
        nodes = self.graph()[0]
        at = nodes.select("id", P.norm(F.col("path")).alias("path"))
        crates = nodes.where("kind = 'Crate'").select("id", P.directory(P.norm(F.col("path"))).alias("dir"), "ord")
        return at.join(rollup.owners(at.select("path").distinct(), crates), "path", "left").select("id", "package")

    def diagram(self, kind: str = "architecture", root: str = "main", before: dict | None = None, locale: str = "en", package: str | None = None) -> dict | None:
        """A diagram record; an unknown kind means architecture.

        The architecture of a tree with packages is drawn package by package, and module by module
        where there are none or a `package` is opened; an unknown one, or one without modules, is None.
        """
        nodes, edges = self.graph()
        if kind == "sequence":
            return diagrams.sequence(nodes, edges, root, locale)
        if kind == "dataflow":
            made = diagrams.dataflow(edges, packages=self.package_of())
            if made["nodes"]:
                return made
            boxes, linked = self.packages()
            return diagrams.file_links(nodes, edges, locale) if boxes.isEmpty() else diagrams.package_level(boxes, linked, self.root, locale)
        if kind == "delta":
            return diagrams.difference(before or {"components": [], "connections": []}, diagrams.architecture(nodes, edges, self.root, locale), self.spark)
        boxes, linked = self.packages()
        if package:
            one = boxes.where((F.col("id") == package) & ~F.col("external")).orderBy("ord").first()
            made = one and diagrams.architecture(nodes, edges, self.root, locale, (one["dir"], one["label"]))
            return made if made and made["components"] else None
        if package == "" or boxes.isEmpty():
            return diagrams.architecture(nodes, edges, self.root, locale)
        return diagrams.package_level(boxes, linked, self.root, locale)

    def tour(self, record: dict, locale: str = "en") -> list[dict]:
        """A record's own tour."""
        return record.get("story") or []

    def render(self, path: str, kind: str = "architecture", **more) -> tuple[str, int]:  # noqa: ANN003
        """Writes a picture of a diagram; returns the path and its bytes."""
        record = self.diagram(kind, **more)
        picture = diagrams.sequence_svg(record) if kind == "sequence" else diagrams.svg(record)
        return diagrams.write_picture(picture, path, self.root)

    def _goals(self) -> DataFrame:
        boards = tree.boards(self.spark, self.root)
        return durable(board.goals(board.preferred(tree.opened(boards, self.root))), "goals")

    def board(self) -> DataFrame:
        return board.summary(self._goals(), BOARD_SCHEMA)

    def board_lines(self) -> DataFrame:
        return board.summary_line(self.board())

    def board_json(self) -> DataFrame:
        rows = self._goals()
        return board.to_json(rows, board.summary(rows, BOARD_SCHEMA))

    def board_report(self) -> DataFrame:
        rows = self._goals()
        return board.report(rows, board.summary(rows, BOARD_SCHEMA))


def other_links(nodes: DataFrame, imports: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import and call edges of scripts, Python, Go, Java and C files."""
    kinds = F.create_map(*[F.lit(x) for lang, endings in extract.LANGUAGE.items() for e in endings.split() for x in (e, lang)])
    lang = F.element_at(kinds, files.extension(F.col("path")))
    paths = nodes.where("kind = 'File'").select("path")
    specs = imports.select(F.expr("substring(file_id, 6)").alias("file"), F.substring("spec", 1, 2).alias("l"), F.expr("substring(spec, 4)").alias("spec"))
    linked = other.script_imports(specs.where("l = 'js'").select("file", "spec"), paths).union(other.python_imports(specs.where("l = 'py'").select("file", "spec"), paths))
    named = facts.where("tag = 'b'").select(F.expr("substring(node_id, 6)").alias("file"), "value")
    # Go, Java and C name other files in their bindings alone.
    bare = named.select("file", F.get(F.split("value", r"\|", 3), F.lit(2)).alias("spec"), F.try_element_at(kinds, files.extension(F.col("file"))).alias("l")).distinct()
    own = lambda lang: (bare.where(F.col("l") == lang).select("file", "spec"), paths.where(F.element_at(kinds, files.extension(F.col("path"))) == lang))
    for found in (other.python_bindings(*own("py")), other.go_imports(*own("go")), other.java_imports(*own("java")), other.c_imports(*own("c"))):
        linked = linked.union(found.where("file <> other_file"))
    linked = durable(linked.distinct(), "linked")
    bound, external = other.bindings(named, linked)
    owner = F.regexp_extract(F.expr("substring(id, length(path) + 2)"), r"^(.*)::[^:]*$", 1)
    pub = facts.where("tag = 'pub'").select(F.col("node_id").alias("id"), F.lit(True).alias("p")).distinct()
    defs = nodes.where(lang.isNotNull() & F.col("kind").isin("Function", "Method", "Class", "Interface", "Enum")).join(pub, "id", "left")
    defs = defs.select("id", "name", "kind", F.col("path").alias("file"), P.directory(F.col("path")).alias("dir"), F.when(owner != "", owner).alias("owner"), F.coalesce("p", F.lit(False)).alias("is_pub"), lang.alias("lang"))
    calls = facts.where("tag = 'c'").join(defs, F.col("node_id") == F.col("id")).select(F.col("id").alias("caller"), F.col("pos").alias("tok_ord"), F.col("value").alias("token"), "file", "dir", "lang", "owner")
    made = other.resolve_other(calls, defs.drop("lang"), linked, bound, external).withColumn("relation", F.lit("Calls"))
    edges = linked.select(F.concat(F.lit("file:"), "file").alias("source"), F.concat(F.lit("file:"), "other_file").alias("target"), F.lit("Imports").alias("relation"), F.lit(1.0).alias("confidence")).distinct()
    return edges, made


def rust_imports(nodes: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, other_file) of Rust import specs."""
    specs = imports.where(F.col("spec").startswith("rs:")).select(F.expr("substring(file_id, 6)").alias("file"), F.expr("substring(spec, 4)").alias("spec"))
    return module_paths(specs, nodes, packages).where("file <> other_file").select("file", "other_file").distinct()


def module_paths(specs: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, spec, other_file) of Rust paths `specs(file, spec)`: the longest module prefix that is a file, else the package's root file.

    Each spec's prefixes meet the modules by equality; no spec is compared with every module.
    """
    paths = nodes.where("kind = 'File'").select(P.norm(F.col("path")).alias("path")).where(F.col("path").endswith(".rs"))
    modules = paths.select("path", P.rust_module(F.col("path")).alias("m")).where("m IS NOT NULL").select("path", "m.root", "m.module")
    # Of two files for one module the library root comes before the program root.
    modules = modules.groupBy("root", "module").agg(F.min_by("path", F.when(F.col("path").endswith("/main.rs"), 1).otherwise(0)).alias("other_file"))
    specs = specs.select("file", "spec", F.split("spec", "::").alias("s"))
    at = specs.join(paths.select(F.col("path").alias("file"), P.rust_module(F.col("path")).alias("m")), "file").where("m IS NOT NULL")
    own = F.split(F.col("m.module"), "::")
    own = F.filter(own, lambda x: x != "")
    rest = F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    # Each leading `super` climbs one module.
    ups = F.size("s") - F.size(F.aggregate("s", F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) == 0) & (x == "super"), kept).otherwise(F.concat(kept, F.array(x)))))
    full = F.when(F.get("s", F.lit(0)) == "crate", rest).when(F.get("s", F.lit(0)) == "self", F.concat(own, rest)).when(F.get("s", F.lit(0)) == "super", F.concat(F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0))), F.slice("s", ups + 1, F.size("s"))))
    inside = at.where(full.isNotNull()).select("file", "spec", F.col("m.root").alias("root"), full.alias("p"))
    outside = at.where(full.isNull()).select("file", "spec", F.get("s", F.lit(0)).alias("head"), rest.alias("p"))
    roots = crate_roots(outside.select("head").distinct(), modules.select("root").distinct(), packages)
    outside = outside.join(roots, "head").select("file", "spec", "root", "p")
    prefixes = inside.union(outside).distinct().select("file", "spec", "root", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda n: F.struct(n.alias("n"), F.concat_ws("::", F.slice("p", F.lit(1), n)).alias("module")))).alias("x"))
    hits = prefixes.select("file", "spec", "root", "x.n", "x.module").join(modules, ["root", "module"])
    return hits.groupBy("file", "spec").agg(F.max_by("other_file", "n").alias("other_file"))


def crate_roots(heads: DataFrame, folders: DataFrame, packages: DataFrame) -> DataFrame:
    """(head, root): the one package root that a path's first segment names.

    A root is known by its folder's name and by its package's code name. A name that no root has is
    taken by the one root whose name is its end after an underscore. A name of several roots names none.
    """
    by_folder = folders.select(F.replace(P.file_name(F.col("root")), F.lit("-"), F.lit("_")).alias("known"), "root")
    by_package = packages.select(F.col("code_name").alias("known"), F.col("dir").alias("root"))
    known = by_folder.union(by_package).distinct().groupBy("known").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    exact = heads.join(known, F.col("head") == F.col("known")).select("head", "n", "root")
    # The ends of a name after each underscore meet the known names by equality.
    cut = F.split("head", "_")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(cut), F.lit(2))), lambda k: F.concat_ws("_", F.slice(cut, k, F.size(cut))))
    rest = heads.join(exact, "head", "left_anti").select("head", F.explode(ends).alias("known")).where("known <> ''").join(known, "known")
    several = rest.groupBy("head").agg(F.count("*").alias("names"), F.max("n").alias("n"), F.min("root").alias("root")).where("names = 1").select("head", "n", "root")
    return exact.union(several).where("n = 1").select("head", "root")


def _shown(rows: DataFrame) -> list[dict]:
    """The first rows of a reply; a last entry says how many are left out."""
    found = [r.asDict() for r in rows.limit(MOST_ROWS + 1).collect()]
    return found if len(found) <= MOST_ROWS else [*found[:MOST_ROWS], {"left_out": rows.count() - MOST_ROWS}]


TOOLS = {
    "index": lambda e, a: {"files": e.index()},
    "ask": lambda e, a: [r.asDict() for r in e.ask(a["query"], a.get("limit", 10), iterations=20).collect()],
    "repo_map": lambda e, a: [r.asDict() for r in e.repo_map(a.get("max_dirs", 30)).collect()],
    "find_all": lambda e, a: {
        "declarations": _shown(e.declarations(a["pattern"], a.get("ignore_case", False)).drop("ord")),
        "lines": _shown(e.grep(a["pattern"], a.get("ignore_case", False))),
    },
    "trace_calls": lambda e, a: _shown(e.trace(a["symbol"])),
    "file_api": lambda e, a: _shown(e.skeleton(a["file"]).select("kind", "name")),
    "check_freshness": lambda e, a: [x.get("path", x) for x in _shown(e.freshness(a.get("cached_at")))],
    "render_diagram": lambda e, a: e.diagram(a.get("type", "architecture"), a.get("entrypoint", "main"), None, a.get("locale", "tr"), a.get("package")),
    "graph_stats": lambda e, a: [r.asDict() for r in e.stats().collect()],
    "goals": lambda e, a: [r.asDict() for r in e.board().collect()],
}


def answer(engine: Engine, line: str) -> str | None:
    """The reply to one request line; a notification has none."""
    reply = lambda i, **body: json.dumps({"jsonrpc": "2.0", "id": i, **body}, ensure_ascii=False, default=str)
    try:
        request = json.loads(line)
    except ValueError:
        return reply(None, error={"code": -32700, "message": "parse error"})
    number, method = request.get("id"), request.get("method")
    if "id" not in request:
        return None
    if method == "tools/list":
        return reply(number, result={"tools": sorted(TOOLS)})
    if method == "tools/call" and request.get("params", {}).get("name") in TOOLS:
        params = request["params"]
        try:
            return reply(number, result=TOOLS[params["name"]](engine, params.get("arguments") or {}))
        except files.StaleCacheError as e:
            return reply(number, error={"code": -32000, "message": str(e)})
    return reply(number, error={"code": -32601, "message": f"unknown method {method}"})


def serve(engine: Engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answers line by line until the input ends."""
    for line in lines:
        if line.strip() and (said := answer(engine, line)) is not None:
            print(said, file=out, flush=True)
