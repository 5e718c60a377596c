"""The engine's questions as SQL of a session: views of an index and a graph, and table functions over them.

    register_search(spark, index); register_graph(spark, nodes, edges)
    spark.sql("SELECT * FROM search('open the store', 10)")
    spark.sql("SELECT p.page_id, s.* FROM pages p, LATERAL search(p.url, 3) s")

The functions are SQL, so Catalyst plans a call together with the statement around it: a lateral call
becomes equi-joins over the distinct arguments. All that is registered is temporary, and a second
call of a register function replaces what the first has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from lumengraph.functions import text as T
from lumengraph.operators import graph, search
from lumengraph.runtime import durable, prepare


def _define(spark: SparkSession, name: str, taken: str, given: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({taken}) RETURNS TABLE({given}) RETURN {body}")


def register_search(spark: SparkSession, index: search.Index) -> None:
    """`search(query, k)`: the k best (place, id, score) of an index, as `search.bm25_many` ranks them.

    An empty or null query finds nothing. The weights of the terms in their documents are written once, as the view
    `term_weights(term, id, weight)`; a search meets the few rows of its terms. `search_terms(words, k)` is the search for an
    array of terms. Goes with `register_terms`; for a table of queries that is known, see `register_searches`.
    """
    register_terms(spark, index)
    weights = search.weighed(index, index.frequencies).withColumnRenamed("w", "weight")
    # In the order of terms, so that a search reads the row groups that may hold its terms.
    durable(weights.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "weights").createOrReplaceTempView("term_weights")
    kind = dict(weights.dtypes)["id"]
    cut = f"SELECT term FROM (SELECT composed(search.query) AS q), LATERAL explode({T.spark_sql_tokens("q")}) AS e(term)"
    for name, taken, asked in (("search", "query STRING", cut), ("search_terms", "words ARRAY<STRING>", "SELECT explode(search_terms.words) AS term")):
        _define(spark, name, f"{taken}, k INT", f"place INT, id {kind}, score DOUBLE", f"""
        SELECT place, id, score FROM (
          SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM (
            SELECT id, round(sum(weight * qtf), 6) AS score
            FROM (SELECT term, count(*) AS qtf FROM ({asked}) GROUP BY term)
            JOIN term_weights USING (term) GROUP BY id HAVING sum(weight * qtf) > {search.LEAST_SCORE}))
        WHERE place <= {name}.k""")  # fmt: skip


def register_terms(spark: SparkSession, index: search.Index) -> None:
    """`query_terms(query)` cuts a query into terms; `index_terms(term)` are all that documents hold, so that a statement can leave out others."""
    prepare(spark)
    spark.udf.register("composed", _composed)
    durable(index.frequencies.select("term"), "terms").createOrReplaceTempView("index_terms")
    _define(spark, "query_terms", "query STRING", "term STRING", f"SELECT e.term FROM (SELECT composed(query_terms.query) AS q), LATERAL explode({T.spark_sql_tokens("q")}) AS e(term)")


def register_searches(spark: SparkSession, index: search.Index, asked: DataFrame, k: int) -> None:
    """`best_of(words)`: the k best (place, id, score) for an array of (term, qtf) in `asked(words)`, as `search` finds them.

    For a table of queries that is known: all are searched at once, and no other term is weighed. What was found is the view `searched`.
    """
    found = search.best(index, asked, k)
    found.createOrReplaceTempView("searched")
    _define(spark, "best_of", "words ARRAY<STRUCT<term: STRING, qtf: BIGINT>>", f"place INT, id {dict(found.dtypes)["id"]}, score DOUBLE", """
        SELECT place, id, score FROM searched WHERE searched.words = best_of.words""")  # fmt: skip


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def register_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> None:
    """Views `nodes` and `edges`, and the functions

    - `neighbours(node)`: (source, target, relation, direction) of its edges, as `graph.neighbours`;
    - `trace_calls(symbol)`: (side, id, of), as `grep.trace`; one symbol, since what holds it isn't found by equality;
    - `hotspots(k)`: the symbols most referred to, as `graph.hotspots`;
    - `nearest(TABLE(...) PARTITION BY ...)`: (query, id, score) of the personalized rank, see `Nearest`.
    """
    prepare(spark)
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    # An equality with each end in turn, where "source or target" would meet every edge with every node; edges are read once.
    _define(spark, "neighbours", "node STRING", "source STRING, target STRING, relation STRING, direction STRING", """
        SELECT source, target, relation, direction FROM edges, LATERAL inline(CASE
          WHEN source = target THEN array(named_struct('node', source, 'direction', 'loop'))
          ELSE array(named_struct('node', source, 'direction', 'out'), named_struct('node', target, 'direction', 'in')) END) AS x(at, direction)
        WHERE x.at = neighbours.node""")  # fmt: skip
    _define(spark, "trace_calls", "symbol STRING", "side STRING, id STRING, of STRING", """
        SELECT 'caller', source, target FROM edges WHERE relation = 'Calls' AND contains(target, trace_calls.symbol)
        UNION ALL SELECT 'callee', target, source FROM edges WHERE relation = 'Calls' AND contains(source, trace_calls.symbol)""")  # fmt: skip
    _define(spark, "hotspots", "k INT", "place INT, name STRING, kind STRING, path STRING, refs BIGINT", r"""
        SELECT place, name, kind, path, refs FROM (
          SELECT name, kind, translate(path, '\\', '/') AS path, refs, row_number() OVER (ORDER BY refs DESC, ord) AS place
          FROM nodes JOIN (SELECT target AS id, count(*) AS refs FROM edges GROUP BY target) USING (id) WHERE kind <> 'File')
        WHERE place <= hotspots.k""")  # fmt: skip
    spark.udtf.register("nearest", Nearest)


@F.udtf(returnType=StructType().add("query", StringType()).add("id", StringType()).add("score", DoubleType()))
class Nearest:
    """Rank from seeds, a group of rows (query, source, target, weight) for each query.

    A row with a target is an edge; one with a weight and no target is a seed, or a node if the weight is
    null. As `graph.rank` with its usual restart and rounds. A group is one task's: beyond `graph.KERNEL_SIZE`
    rows it is refused, and `graph.rank` is the way.
    """

    def __init__(self) -> None:
        self.query, self.nodes, self.links, self.seeds, self.size = None, set(), [], {}, 0

    def eval(self, row) -> Iterator:  # noqa: ANN001
        self.size += 1
        if self.size > graph.KERNEL_SIZE:
            raise ValueError(f"more than {graph.KERNEL_SIZE} rows in one group: use graph.rank")
        self.query = row["query"]
        if row["target"] is not None:
            self.links.append((row["source"], row["target"]))
        elif row["weight"] is not None:
            self.seeds[row["source"]] = self.seeds.get(row["source"], 0.0) + row["weight"]
        else:
            self.nodes.add(row["source"])
        return iter(())

    def terminate(self) -> Iterator:
        if not self.seeds:
            return
        ids = sorted(self.nodes)
        at = {x: k for k, x in enumerate(ids)}
        links = np.array([(at[s], at[t]) for s, t in self.links if s in at and t in at], np.int64).reshape(-1, 2)
        scores = graph.walked(len(ids), links[:, 0], links[:, 1], graph._teleport(ids, self.seeds))
        for x, score in zip(ids, scores, strict=True):
            if score > graph.LEAST_RANK:
                yield self.query, x, float(score)
