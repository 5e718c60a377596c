"""Queries that end in records: extraction, goal boards, diagrams, display, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import display as V
from lumengraph.functions import labels as L
from lumengraph.operators import diagrams, extract
from lumengraph.plans.resolution import _MOD
from lumengraph.runtime import table
from lumengraph.sources import board, files
from lumengraph.sources import driver_graph as D
from lumengraph.streaming import watch


def _record(spark: SparkSession, record: dict) -> DataFrame:
    return spark.createDataFrame([(diagrams.to_json(record),)], "record string")


def architecture_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return _record(spark, diagrams.architecture(g.nodes, g.edges, "tables"))


def architecture_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return spark.createDataFrame([(diagrams.svg(diagrams.architecture(g.nodes, g.edges, "tables")),)], "svg string")


def dataflow_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(spark, diagrams.dataflow(D.load(spark, sf_dir).edges))


def sequence_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    return _record(spark, diagrams.sequence(g.nodes, g.edges, "fn_12"))


def architecture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the record."""
    g = D.load(spark, sf_dir)
    rows = diagrams.architecture(g.nodes, g.edges)["components"]
    return spark.createDataFrame([(c["id"], c["label"], c["region"], c["role"], c["sublabel"]) for c in rows], "id string, label string, region string, role string, sublabel string")


def architecture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the record, the heaviest sixty."""
    g = D.load(spark, sf_dir)
    rows = diagrams.architecture(g.nodes, g.edges)["connections"]
    return spark.createDataFrame([(x["from"], x["to"], x["label"], x["weight"]) for x in rows], "`from` string, `to` string, label string, weight bigint")


def dataflow_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the data-flow record shows, and how many users it leaves out."""
    record = diagrams.dataflow(D.load(spark, sf_dir).edges)
    rows = [(x["from"], x["to"], x["kind"], record["hidden"].get(x["from"], record["hidden"].get(x["to"]))) for x in record["pipelines"]]
    return spark.createDataFrame(rows, "`from` string, `to` string, kind string, hidden bigint")


def delta_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and links of two records, by what became of them; the later one has no classes."""
    g = D.load(spark, sf_dir)
    made = diagrams.difference(diagrams.architecture(g.nodes, g.edges), diagrams.architecture(g.nodes.where("kind <> 'Class'"), g.edges), spark)
    rows = [("component", c["id"], c["status"]) for c in made["components"]] + [("link", f"{x['from']} {x['to']}", x["status"]) for x in made["connections"]]
    return spark.createDataFrame(rows, "what string, name string, status string")


def delta_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.load(spark, sf_dir)
    one, two = (diagrams.architecture(g.nodes.where(f"kind <> '{k}'"), g.edges) for k in ("Class", "Crate"))
    return _record(spark, diagrams.difference(one, two, spark))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction of one Rust file per part."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("pub fn run_"), k, F.lit("() {\n    helper_"), k % 7, F.lit("(); // fake()\n}\nfn helper_"), k, F.lit("() { std::fs::read(\"in.csv\"); }\n"))
    rows = extract.tagged(table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), text.alias("text")))
    return rows.where("tag IN ('node', 'fact')").select("path", "tag", "id", "kind", "value", "start_line", "end_line")


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    path = F.concat(pick(("src", "target", ".git", ".claude", "x-out", "docs/diyagramlar"), k), F.lit("/f"), k, F.lit("."), pick(("rs", "json", "py", "MD", "sqlite", "cc", "h"), F.floor(k / 6)))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", (files.supported(F.col("path")) & ~files.pruned(F.col("path"))).alias("read"), files.language(F.col("path")).alias("language"))


def board_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON board per hundred labelled documents, read back and summed up."""
    word = F.when(F.col("toxic") == 1, "wontdo").when(F.col("quality") == 1, "TAMAM").otherwise("who knows")
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), word.alias("durum")))
    docs = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 100).alias("k"), one.alias("row"))
    texts = docs.groupBy("k").agg(F.concat(F.lit('{"hedefler": ['), F.concat_ws(",", F.array_sort(F.collect_list("row"))), F.lit("]}")).alias("t"))
    found = texts.select(F.concat(F.lit("r"), "k", F.lit("/.harness/hedefler.json")).alias("path"), F.col("t").cast("binary").alias("content"))
    return board.summary(board.goals(board.preferred(found)), "goals/1").select("path", "goals", "done", "deferred", "unreadable", "green")


def text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", V.fit_text(F.concat("p_name", F.lit(" of "), "p_brand", F.lit(".parquet")), F.col("p_size").cast("double") * 5, F.lit(12.0), F.lit(8.0)).alias("x"))
    return rows.select("p_partkey", "x.text", "x.font", "x.truncated")


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", V.escaped(F.col("url")).alias("url"), V.shortened(F.col("url"), 24).alias("short"), V.number(F.col("page_id") / 4).alias("number"))


def wiring_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit(1).alias("v"), (F.col("p_partkey") * 97).alias("n"), F.array(F.lit("rust")).alias("l"))
    return rows.select("k", F.hex(V.wiring_bytes("v", "n", "k", "l")).alias("bytes"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: events per hour and type."""
    rows = watch.windows(table(spark, sf_dir, "events"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def uses_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select("p_partkey", L.uses_label(n, "en").alias("en"), L.uses_label(n, "tr").alias("tr"))


_LE = "CASE WHEN {n} < 251 THEN printf('%02X', {n}) WHEN {n} < 65536 THEN 'FB' || printf('%02X%02X', {n} % 256, {n} // 256) ELSE 'FC' || printf('%02X%02X%02X%02X', {n} % 256, {n} // 256 % 256, {n} // 65536 % 256, {n} // 16777216) END"

QUERIES = {
    f.__name__: f
    for f in (architecture_components, architecture_links, dataflow_pipelines, delta_statuses, architecture_ir, architecture_svg, dataflow_ir, sequence_ir, delta_ir, source_rows, supported_files, board_goals, text_fit, markup, wiring_record, event_windows, uses_labels)
}
_TOP = 'SELECT "from", "to", label, weight FROM ln'
_LINKS = f"""{_MOD}, ln AS (SELECT "from", "to", CASE dominant WHEN 'Calls' THEN 'calls' WHEN 'Imports' THEN 'imports' ELSE dominant END || ' ×' || "count" AS label, "count" AS weight FROM dp ORDER BY "count" DESC, "from", "to" LIMIT 60)"""
ORACLES = {
    "architecture_components": f"WITH {_MOD} SELECT key AS id, module AS label, region, 'Backend' AS role, files || ' files · ' || symbols || ' symbols' AS sublabel FROM ms",
    "architecture_links": f"WITH {_LINKS} {_TOP}",
    "dataflow_pipelines": f"""WITH {D.SQL}, io AS (SELECT * FROM edges WHERE relation IN ('Writes', 'Reads')),
      t AS (SELECT target AS artifact FROM io GROUP BY target ORDER BY bool_or(relation = 'Writes') AND bool_or(relation = 'Reads') DESC, count(DISTINCT source) DESC, target LIMIT 10),
      u AS (SELECT target AS artifact, source AS who, min(ord) AS ord FROM io GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY ord, who) AS place, greatest(count(*) OVER (PARTITION BY artifact) - 4, 0) AS hidden FROM u)
      SELECT CASE relation WHEN 'Writes' THEN who ELSE artifact END AS "from", CASE relation WHEN 'Writes' THEN artifact ELSE who END AS "to", CASE relation WHEN 'Writes' THEN 'write' ELSE 'read' END AS kind, hidden
      FROM r JOIN t USING (artifact) JOIN (SELECT DISTINCT target, source, relation FROM io) i ON i.target = artifact AND i.source = who WHERE place <= 4""",
    "delta_statuses": f"""WITH {_LINKS}, c AS (SELECT key, count(*) FILTER (WHERE kind = 'Class') AS classes FROM m GROUP BY key)
      SELECT 'component' AS what, key AS name, CASE WHEN classes > 0 THEN 'Modified' ELSE 'Unchanged' END AS status FROM c UNION ALL SELECT 'link', "from" || ' ' || "to", 'Unchanged' FROM ln""",
    "source_rows": """WITH p AS (SELECT p_partkey AS k, 'src/p' || p_partkey || '.rs' AS path FROM part)
      SELECT path, 'node' AS tag, 'file:' || path AS id, 'File' AS kind, NULL AS value, NULL::INTEGER AS start_line, NULL::INTEGER AS end_line FROM p
      UNION ALL SELECT path, 'node', path || ':run_' || k, 'Function', NULL, 1, 3 FROM p
      UNION ALL SELECT path, 'node', path || ':helper_' || k, 'Function', NULL, 4, 4 FROM p
      UNION ALL SELECT path, 'fact', path || ':run_' || k, NULL, unnest(['c:helper_' || (k % 7), 'pub']), NULL, NULL FROM p
      UNION ALL SELECT path, 'fact', path || ':helper_' || k, NULL, unnest(['c:std::fs::read', 'a:in.csv', 'io:r']), NULL, NULL FROM p
      UNION ALL SELECT path, 'fact', 'file:' || path, NULL, 'loc:4', NULL, NULL FROM p""",
    "supported_files": """SELECT p_partkey, (p_partkey % 6 IN (0, 3)) AND (p_partkey // 6 % 7 IN (0, 2, 4, 6)) AS read,
      (['rust', 'json', 'python', NULL, NULL, NULL, 'c'])[p_partkey // 6 % 7 + 1] AS language FROM part""",
    "board_goals": """WITH s AS (SELECT doc_id // 100 AS k, CASE WHEN toxic = 1 THEN 'deferred' WHEN quality = 1 THEN 'done' ELSE 'unreadable' END AS state FROM labels)
      SELECT 'r' || k || '/.harness/hedefler.json' AS path, count(*) AS goals, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'deferred') AS deferred,
      count(*) FILTER (WHERE state = 'unreadable') AS unreadable, bool_and(state = 'done') AS green FROM s GROUP BY k""",
    "markup": """SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS url,
      CASE WHEN length(url) <= 24 THEN url ELSE substr(url, 1, 23) || '…' END AS short, regexp_replace(printf('%.1f', CASE page_id % 4 WHEN 1 THEN page_id // 4 + 0.3 WHEN 3 THEN page_id // 4 + 0.8 ELSE page_id / 4 END), '\\.0$', '') AS number FROM pages""",
    "wiring_record": f"SELECT p_partkey AS k, '01' || {_LE.format(n='(p_partkey * 97)')} || {_LE.format(n='p_partkey')} || '010472757374' AS bytes FROM part",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "uses_labels": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'depends' ELSE 'uses ×' || (p_size % 5) END AS en, CASE WHEN p_size % 5 = 0 THEN 'bağımlı' ELSE 'kullanır ×' || (p_size % 5) END AS tr FROM part",
}
