"""Queries for import files, data flow, paths and boards, over files and specs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph import engine
from lumengraph.functions import labels as L
from lumengraph.functions import paths as P
from lumengraph.operators import imports, resolve, rollup
from lumengraph.runtime import table
from lumengraph.sources import board
from lumengraph.sources import driver_graph as D


def _text(*bits) -> Column:  # noqa: ANN002
    return F.concat(*[b if isinstance(b, Column) else F.lit(b) for b in bits])


def _pick(k: Column, *cases: Column) -> Column:
    return F.element_at(F.array(*cases), (k % len(cases) + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str, path) -> DataFrame:  # noqa: ANN001
    """A file per part."""
    return table(spark, sf_dir, "part").select(path(F.col("p_partkey")).alias("path")).distinct()


def _specs(spark: SparkSession, sf_dir: str, file, spec) -> DataFrame:  # noqa: ANN001
    """An import per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(file(k).alias("file"), spec(k).alias("spec")).distinct()


def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`./m3`, `../d2/m3` and a package, over files with four kinds of endings."""
    files = _files(spark, sf_dir, lambda k: _text("web/d", k % 5, "/m", k % 40, _pick(k, *map(F.lit, (".ts", ".js", "/index.ts", ".tsx", ".mjs", "/index.js", ".cts")))))
    specs = _specs(spark, sf_dir, lambda k: _text("web/d", k % 5, "/a", k % 9, ".ts"), lambda k: _pick(k, _text("./m", k % 47), _text("../d", k % 7, "/./m", k % 41), _text("pkg", k % 40)))
    return imports.script_imports(specs, files)


def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One and two dots, and dotted names that end one file's path alone."""
    files = _files(spark, sf_dir, lambda k: _text("app/p", k % 6, "/s", k % 31, F.when(k % 7 == 0, "/__init__.py").otherwise(".py")))
    specs = _specs(spark, sf_dir, lambda k: _text("app/p", k % 6, "/a", k % 5, ".py"), lambda k: _pick(k, _text(".s", k % 37), _text("..p", k % 8, ".s", k % 31), _text("p", k % 8, ".s", k % 31), _text("s", k % 31)))
    return imports.python_imports(specs, files)


def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one folder that ends in a spec's last parts."""
    files = _files(spark, sf_dir, lambda k: _text("m/x", k % 4, "/st", k % 13, "/f", k % 3, ".go"))
    specs = _specs(spark, sf_dir, lambda k: _text("m/cmd", k % 3, "/e.go"), lambda k: _pick(k, _text("host.io/x", k % 5, "/st", k % 13), _text("st", k % 15), _text("host.io/st", k % 13), _text("m/x", k % 4, "/st", k % 15)))
    return imports.go_imports(specs, files)


def java_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class's files, else all of a package's."""
    files = _files(spark, sf_dir, lambda k: _text(_pick(k, F.lit("jv"), F.lit("old")), "/a", k % 4, "/b", k % 9, "/C", k % 25, ".java"))
    specs = _specs(spark, sf_dir, lambda k: _text("jv/M", k % 3, ".java"), lambda k: _pick(k, _text("a", k % 4, ".b", k % 9, ".C", k % 27), _text("a", k % 5, ".b", k % 9), _text("java.util.L", k % 4)))
    return imports.java_imports(specs, files)


def c_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header beside the file, else by its end, and the sources that stand by a header."""
    files = _files(spark, sf_dir, lambda k: _text("c/d", k % 5, "/u", k % 20, _pick(k, *map(F.lit, (".h", ".c", ".hpp")))))
    specs = _specs(spark, sf_dir, lambda k: _text("c/d", k % 5, "/main", k % 2, ".c"), lambda k: _pick(k, _text("u", k % 22, ".h"), _text("d", k % 6, "/u", k % 20, ".hpp"), _text("../d", k % 5, "/u", k % 20, ".h")))
    return imports.c_imports(specs, files)


def artifact_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reads or writes is tied to the files it names, or to those that its callees name."""
    g = D.load(spark, sf_dir)
    functions = g.nodes.where("kind = 'Function'")
    k = F.col("ord") - 10_000
    io = functions.where(k % 3 < 2).select("id", F.when(k % 3 == 0, "r").otherwise("w").alias("op"))
    names = functions.where(k % 4 == 0).select("id", _text("f", k % 50, ".csv").alias("artifact"))
    return resolve.artifact_flow(functions, io, names, g.edges.where("relation = 'Calls'").select("source", "target"))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined paths, the folder where two part, module names."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, _text("w/a", k % 3, "/b").alias("base"), _pick(k, _text("../c/./d", k), _text("../../../far/lib", k), _text("x/../y", k % 9), _text("..\\\\n", k % 4, "\\\\mod.rs"), F.lit("../../..")).alias("spec"))
    joined = P.join_norm(F.col("base"), F.col("spec"))
    return rows.select("p_partkey", joined.alias("joined"), P.sibling_repo(F.col("base"), joined).alias("repo"), P.module_name(F.concat(joined, F.lit("/mod.rs"))).alias("module"))


def shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all files share, and what those of one package share, without a source folder at its end."""
    files = D.load(spark, sf_dir).nodes.where("kind = 'File'").select("path")
    one = files.where(F.col("path").startswith("crates/r1/"))
    told = [(name, *rollup.common_prefix(some)) for name, some in (("all", files), ("one", one))]
    return spark.createDataFrame(told, "name string, n int, root string")


def board_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boards in both schemas with words in three languages and none, counted in a line each."""
    labels = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    word = _pick(k, *[F.lit(w) for w in ("done", "Bitti", "kısmi", "partial", "ertelendi", "???")], F.lit(None).cast("string"))
    goals = labels.groupBy((k % 40).alias("b")).agg(F.array_sort(F.collect_list(F.struct(k.alias("id"), word.alias("word")))).alias("g"))
    listed = F.transform("g", lambda x: F.struct(x["id"].cast("string").alias("id"), x["word"].alias("status")))
    old = F.transform("g", lambda x: F.struct(x["id"].cast("string").alias("id"), x["word"].alias("durum")))
    text = F.when(F.col("b") % 2 == 0, F.to_json(F.struct(F.lit(engine.BOARD_SCHEMA).alias("schema"), listed.alias("features")))).otherwise(F.to_json(F.struct(old.alias("hedefler"))))
    files = goals.select(_text("r", F.col("b"), "/.harness/", board.NEW_FILE).alias("path"), text.cast("binary").alias("content"))
    return board.summary_line(board.summary(board.goals(files), engine.BOARD_SCHEMA))


def _at(*cases: str) -> str:
    """SQL for one of the cases by the number of `k`."""
    return f"([{', '.join(cases)}])[k % {len(cases)} + 1]"


def _sql(path: str, file: str, spec: str, rest: str) -> str:
    return f"""WITH f AS (SELECT DISTINCT {path} AS path FROM (SELECT p_partkey AS k FROM part)), s AS (SELECT DISTINCT {file} AS file, {spec} AS spec FROM (SELECT o_orderkey AS k FROM orders)), {rest}"""


_ENDINGS = ", ".join(f"'{e}'" for e in imports.SCRIPT_ENDINGS)
_DOTTED = "replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.')"
_STATES = {"done": "'done', 'Bitti'", "partial": "'kısmi', 'partial'", "deferred": "'ertelendi'"}

QUERIES = {f.__name__: f for f in (script_imports, python_imports, go_imports, java_imports, c_imports, artifact_flow, path_rules, shared_prefix, board_lines)}
ORACLES = {
    "script_imports": _sql(
        f"'web/d' || (k % 5) || '/m' || (k % 40) || {_at(*(f"'{e}'" for e in ('.ts', '.js', '/index.ts', '.tsx', '.mjs', '/index.js', '.cts')))}", "'web/d' || (k % 5) || '/a' || (k % 9) || '.ts'",
        _at("'./m' || (k % 47)", "'../d' || (k % 7) || '/./m' || (k % 41)", "'pkg' || (k % 40)"),
        f"""b AS (SELECT *, CASE WHEN spec LIKE './%' THEN regexp_extract(file, '^(.*)/', 1) || spec[2:] ELSE 'web' || replace(spec[3:], '/./', '/') END AS base FROM s WHERE spec LIKE '.%'),
        c AS (SELECT file, spec, base || e AS path, r FROM b, (SELECT unnest([{_ENDINGS}]) AS e, unnest(range({len(imports.SCRIPT_ENDINGS)})) AS r))
        SELECT file, spec, arg_min(path, r) AS other_file FROM c JOIN f USING (path) GROUP BY ALL""",
    ),
    "python_imports": _sql(
        "'app/p' || (k % 6) || '/s' || (k % 31) || CASE WHEN k % 7 = 0 THEN '/__init__.py' ELSE '.py' END", "'app/p' || (k % 6) || '/a' || (k % 5) || '.py'",
        _at("'.s' || (k % 37)", "'..p' || (k % 8) || '.s' || (k % 31)", "'p' || (k % 8) || '.s' || (k % 31)", "'s' || (k % 31)"),
        f"""near AS (SELECT file, spec, CASE WHEN spec LIKE '..%' THEN 'app/' || replace(spec[3:], '.', '/') ELSE regexp_extract(file, '^(.*)/', 1) || '/' || spec[2:] END AS base FROM s WHERE spec LIKE '.%'),
        far AS (SELECT spec, min(path) AS other_file FROM (SELECT DISTINCT spec FROM s WHERE spec NOT LIKE '.%') JOIN f ON {_DOTTED} = spec OR {_DOTTED} LIKE '%.' || spec GROUP BY spec HAVING count(*) = 1)
        SELECT file, spec, arg_min(path, length(path)) AS other_file FROM near JOIN f ON path = base || '.py' OR path = base || '/__init__.py' GROUP BY ALL
        UNION ALL SELECT file, spec, other_file FROM s JOIN far USING (spec)""",
    ),
    "go_imports": _sql(
        "'m/x' || (k % 4) || '/st' || (k % 13) || '/f' || (k % 3) || '.go'", "'m/cmd' || (k % 3) || '/e.go'", _at("'host.io/x' || (k % 5) || '/st' || (k % 13)", "'st' || (k % 15)", "'host.io/st' || (k % 13)", "'m/x' || (k % 4) || '/st' || (k % 15)"),
        """d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir FROM f),
        t AS (SELECT spec, n, array_to_string(string_split(spec, '/')[-n:], '/') AS tail, len(string_split(spec, '/')) AS parts FROM (SELECT DISTINCT spec, unnest(range(1, least(3, len(string_split(spec, '/'))) + 1)) AS n FROM s)),
        h AS (SELECT spec, n, parts, count(*) AS dirs, min(dir) AS dir FROM t JOIN d ON dir LIKE '%/' || tail GROUP BY ALL),
        b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY spec ORDER BY n DESC) = 1)
        SELECT file, spec, path AS other_file FROM s JOIN b USING (spec) JOIN f ON regexp_extract(path, '^(.*)/', 1) = dir WHERE dirs = 1 AND (n > 1 OR parts = 1 OR spec NOT LIKE '%.%')""",
    ),
    "java_imports": _sql(
        f"{_at("'jv'", "'old'")} || '/a' || (k % 4) || '/b' || (k % 9) || '/C' || (k % 25) || '.java'", "'jv/M' || (k % 3) || '.java'", _at("'a' || (k % 4) || '.b' || (k % 9) || '.C' || (k % 27)", "'a' || (k % 5) || '.b' || (k % 9)", "'java.util.L' || (k % 4)"),
        """c AS (SELECT file, spec, path FROM s JOIN f ON path LIKE '%/' || replace(spec, '.', '/') || '.java')
        SELECT file, spec, path AS other_file FROM c UNION ALL SELECT file, spec, path FROM s JOIN f ON regexp_extract(path, '^(.*)/', 1) LIKE '%/' || replace(spec, '.', '/') WHERE spec NOT IN (SELECT spec FROM c)""",
    ),
    "c_imports": _sql(
        f"'c/d' || (k % 5) || '/u' || (k % 20) || {_at("'.h'", "'.c'", "'.hpp'")}", "'c/d' || (k % 5) || '/main' || (k % 2) || '.c'", _at("'u' || (k % 22) || '.h'", "'d' || (k % 6) || '/u' || (k % 20) || '.hpp'", "'../d' || (k % 5) || '/u' || (k % 20) || '.h'"),
        """n AS (SELECT *, CASE WHEN spec LIKE '../%' THEN 'c' || spec[3:] ELSE regexp_extract(file, '^(.*)/', 1) || '/' || spec END AS near FROM s),
        close AS (SELECT file, spec, path FROM n JOIN f ON path = near),
        far AS (SELECT file, spec, path FROM s JOIN f ON path LIKE '%/' || spec WHERE NOT EXISTS (SELECT 1 FROM close c WHERE c.file = s.file AND c.spec = s.spec)),
        hits AS (SELECT * FROM close UNION SELECT * FROM far)
        SELECT file, spec, path AS other_file FROM hits UNION SELECT h.file, h.spec, f.path FROM hits h JOIN f ON f.path IN (SELECT unnest([regexp_replace(h.path, '\\.h(pp)?$', '.' || e) FOR e IN ['c', 'cpp', 'cc', 'cxx']])) WHERE h.path LIKE '%.h' OR h.path LIKE '%.hpp'""",
    ),
    "artifact_flow": f"""WITH {D.SQL}, fn AS (SELECT id, ord - 10000 AS k FROM nodes WHERE kind = 'Function'), nm AS (SELECT id, 'f' || (k % 50) || '.csv' AS artifact FROM fn WHERE k % 4 = 0),
      io AS (SELECT id, CASE WHEN k % 3 = 0 THEN 'Reads' ELSE 'Writes' END AS relation FROM fn WHERE k % 3 < 2)
      SELECT io.id AS source, 'artifact:' || artifact AS target, relation, 0.9::DOUBLE AS confidence FROM io JOIN nm USING (id)
      UNION SELECT io.id, 'artifact:' || artifact, io.relation, 0.9 FROM io JOIN edges e ON e.source = io.id AND e.relation = 'Calls' JOIN nm ON nm.id = e.target WHERE io.id NOT IN (SELECT id FROM nm)""",
    "path_rules": """SELECT p_partkey, joined, repo, CASE WHEN joined = '' THEN '' ELSE string_split(joined, '/')[-1] END AS module FROM (
      SELECT p_partkey, CASE k % 5 WHEN 0 THEN 'w/a' || (k % 3) || '/c/d' || k WHEN 1 THEN 'far/lib' || k WHEN 2 THEN 'w/a' || (k % 3) || '/b/y' || (k % 9) WHEN 3 THEN 'w/a' || (k % 3) || '/n' || (k % 4) || '/mod.rs' ELSE '' END AS joined,
        CASE k % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'far' WHEN 2 THEN 'y' || (k % 9) WHEN 3 THEN 'n' || (k % 4) ELSE '' END AS repo FROM (SELECT p_partkey, p_partkey AS k FROM part))""",
    "shared_prefix": f"""WITH {D.SQL}, p AS (SELECT 'all' AS name, path FROM nodes WHERE kind = 'File' UNION ALL SELECT 'one', path FROM nodes WHERE kind = 'File' AND path LIKE 'crates/r1/%'),
      e AS (SELECT name, string_split(min(path), '/') AS a, string_split(max(path), '/') AS b FROM p GROUP BY name),
      c AS (SELECT name, a, len(list_filter(range(1, len(a)), lambda i: a[1:i] = b[1:i])) AS n FROM e),
      t AS (SELECT name, a, CASE WHEN a[n] = 'src' THEN n - 1 ELSE n END AS n FROM c)
      SELECT name, n::INTEGER AS n, a[n] AS root FROM t""",
    "board_lines": f"""WITH g AS (SELECT doc_id % 40 AS b, {_at("'done'", "'Bitti'", "'kısmi'", "'partial'", "'ertelendi'", "'???'", 'NULL')} AS w FROM (SELECT doc_id, doc_id AS k FROM labels))
      SELECT 'r' || b || '/.harness/{board.NEW_FILE}' AS path, count(*) || ' goals · ' || {" || ' · ' || ".join(f"count(*) FILTER (WHERE w IN ({_STATES[s]})) || ' {s}'" if s in _STATES else (f"count(*) FILTER (WHERE coalesce(w, '???') = '???') || ' {s}'" if s == L.UNREADABLE else f"'0 {s}'") for s in [*L.STATUS_WORDS, L.UNREADABLE])} AS line FROM g GROUP BY b""",
}
