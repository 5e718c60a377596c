"""Edges are dealt by a number of tasks that stays, before anything holds many of them; and read once."""

from lumengraph import session
from lumengraph.operators import rollup

EDGES = "ord long, source string, target string, relation string"
ROWS = [(1, "a", "x.csv", "Writes"), (2, "a", "x.csv", "Reads"), (3, "b", "x.csv", "Reads"), (4, "a", "b", "Calls"), (5, "b", "b", "Calls"), (6, "b", "gone", "Calls")]


def dealings(spark, df, column):
    """The shuffles whose rows have a column, by their plan."""
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [b for b in plan.split("\n\n") if ") Exchange" in b and f"{column}#" in b.split("Arguments")[0]]


def test_users_of_files_are_not_grouped_before_they_are_dealt(spark):
    found = rollup.artifact_pairs(spark.createDataFrame(ROWS, EDGES))
    assert all("REPARTITION_BY_NUM" in b for b in dealings(spark, found, "target"))
    assert not dealings(spark, found, "artifact")
    assert sorted(map(tuple, found.collect())) == [("x.csv", "a", 1, True, True), ("x.csv", "b", 3, False, True)]


def test_links_of_modules_meet_targets_first(spark, monkeypatch):
    plans = []
    kept = rollup.durable
    monkeypatch.setattr(rollup, "durable", lambda df, name="table": plans.append((name, dealings(spark, df, "relation"))) or kept(df, name))
    placed = spark.createDataFrame([("a", "a", "Function", "r", "r/a"), ("b", "b", "Function", "r", "r/b")], "id string, name string, kind string, region string, key string")
    found = rollup.dependencies(placed, spark.createDataFrame(ROWS, EDGES))
    shuffles = dict(plans)["module_links"]
    assert len(shuffles) == 2 and all("REPARTITION_BY_NUM" in b for b in shuffles)
    assert sum("hashpartitioning(target" in b and "to#" not in b for b in shuffles) == 1 and sum("hashpartitioning(source" in b and "to#" in b for b in shuffles) == 1
    assert [tuple(r) for r in found.collect()] == [("r/a", "r/b", 1, "Calls")]


def test_neighbours_read_edges_once(spark):
    edges = spark.createDataFrame(ROWS, EDGES)
    nodes = spark.createDataFrame([(1, "a", "", "a", "Function"), (2, "b", "", "b", "Function")], "ord long, id string, path string, name string, kind string")
    session.register_graph(spark, nodes, edges)
    found = spark.sql("SELECT n.id, e.* FROM nodes AS n, LATERAL neighbours(n.id) AS e")
    assert sorted(map(tuple, found.collect())) == sorted([
        ("a", "a", "x.csv", "Writes", "out"), ("a", "a", "x.csv", "Reads", "out"), ("a", "a", "b", "Calls", "out"), ("b", "a", "b", "Calls", "in"),
        ("b", "b", "x.csv", "Reads", "out"), ("b", "b", "b", "Calls", "loop"), ("b", "b", "gone", "Calls", "out"),
    ])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert sum("Scan ExistingRDD" in b and "relation#" in b for b in plan.split("\n\n")) == 1
