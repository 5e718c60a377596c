"""Queries that are SQL statements over what a session has registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumengraph import session
from lumengraph.operators import search
from lumengraph.plans.text_search import ORACLES as TEXT_ORACLES
from lumengraph.runtime import durable, table
from lumengraph.sources import driver_graph as D


def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: the three best documents for the address of every page, by a lateral call of `best_of`, which searches once for each set of words."""
    index = search.stored(search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text"))
    session.register_terms(spark, index)
    asked = durable(spark.sql("""
        SELECT page_id, array_sort(collect_list(struct(term, qtf))) AS words FROM (
          SELECT page_id, term, count(*) AS qtf FROM {pages}, LATERAL query_terms(url) LEFT SEMI JOIN index_terms USING (term) GROUP BY page_id, term)
        GROUP BY page_id""", pages=table(spark, sf_dir, "pages")), "asked")  # fmt: skip
    session.register_searches(spark, index, asked, 3)
    return spark.sql("SELECT page_id, s.place, s.id AS doc_id, s.score FROM {asked} AS a, LATERAL best_of(a.words) AS s", asked=asked)


def sql_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12, G9: the edges of every file with their directions, by a lateral call of `neighbours`."""
    g = D.load(spark, sf_dir)
    session.register_graph(spark, g.nodes, g.edges)
    # Written, so that their size is known: where they are few no edge is shuffled to meet them.
    asked = durable(spark.sql("SELECT id FROM nodes WHERE kind = 'File'"), "asked")
    return spark.sql("SELECT n.id, e.source, e.target, e.relation, e.direction FROM {asked} AS n, LATERAL neighbours(n.id) AS e", asked=asked)


QUERIES = {f.__name__: f for f in (sql_search, sql_neighbours)}
ORACLES = {
    "sql_search": TEXT_ORACLES["bm25_batch"],
    "sql_neighbours": f"""WITH {D.SQL} SELECT n.id, source, target, relation, CASE WHEN source = target THEN 'loop' WHEN source = n.id THEN 'out' ELSE 'in' END AS direction
      FROM nodes n JOIN edges ON source = n.id OR target = n.id WHERE n.kind = 'File'""",
}
