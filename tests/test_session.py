"""SQL functions of a session against the operators they stand for."""

import random

import pytest

from lumengraph import session
from lumengraph.functions import text as T
from lumengraph.operators import graph, grep, search
from lumengraph.runtime import written


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    names = [f"n{k}" for k in range(25)]
    nodes = spark.createDataFrame([(k, n, f"src\\a{k % 3}.rs", n, "File" if k % 5 == 0 else "Function") for k, n in enumerate(names)], "ord int, id string, path string, name string, kind string")
    links = [(rng.choice(names), rng.choice([*names, "gone"]), rng.choice(["Calls", "Uses"])) for _ in range(70)] + [("n1", "n1", "Calls")] * 2
    edges = spark.createDataFrame(links, "source string, target string, relation string").cache()
    session.register_graph(spark, nodes, edges)
    return nodes, edges


def test_tokens_in_sql_are_the_tokenizer(spark):
    texts = ["getHTTPResponse a_1B-c2D", "İstanbul ISPARTA ılık", "it's \"so\" (x) [yy];zz", "أحمد مُدَرِّسَة", "ΣΑΣ é, 　ok", "", None, "a\\b/cc:dd<ee>"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    df.createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT {T.spark_sql_tokens('q')} AS t FROM texts").collect()
    assert [r.t for r in got] == [r.t for r in df.select(T.tokens(df.q).alias("t")).collect()]


def test_search(spark):
    rng = random.Random(2)
    words = ["open", "store", "read", "HTTPServer", "café", "x1"]
    docs = [(f"d{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in range(60)] + [("empty", ""), ("none", None)]
    frame = spark.createDataFrame(docs, "id string, text string")
    index = search.stored(search.build_index(frame, "id", "text"))
    session.register_search(spark, index)
    queries = ["open the store open", "café server", "", None, "unknown words", "open the store open"]
    asked = spark.createDataFrame([*enumerate(queries)], "query_id int, query string")
    asked.createOrReplaceTempView("asked")
    want = rows(search.bm25_many(index, asked, 4).select("query_id", "place", "id", "score"))
    assert want and rows(spark.sql("SELECT query_id, s.* FROM asked, LATERAL search(query, 4) s")) == want
    one = [(r.place, r.id, r.score) for r in spark.sql("SELECT * FROM search('café server', 4) ORDER BY place").collect()]
    assert one == [w[1:] for w in want if w[0] == 1]
    assert rows(spark.sql("SELECT * FROM search('', 3)")) == []
    session.register_search(spark, search.build_index(frame.where("id = 'd1'"), "id", "text"))  # replaces the first
    assert {r.id for r in spark.sql("SELECT * FROM search('open store read http cafe x1', 4)").collect()} <= {"d1"}


def test_graph_functions(spark, small):
    nodes, edges = small
    got = rows(spark.sql("SELECT n.id, e.* FROM nodes n, LATERAL neighbours(n.id) e"))
    assert got == sorted((i, *r) for i in (f"n{k}" for k in range(25)) for r in rows(graph.neighbours(edges, i)))
    assert rows(spark.sql("SELECT * FROM trace_calls('n1')")) == rows(grep.trace(edges, "n1"))
    want = [tuple(r) for r in graph.hotspots(nodes, edges, 6).collect()]
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM hotspots(6) ORDER BY place").collect()] == want


def test_nearest_is_the_rank_per_query(spark, small):
    nodes, edges = small
    seeds = {"a": [("n1", 1.0), ("n2", 0.5), ("gone", 3.0)], "b": [("n7", 1.0), ("n7", 1.0)]}
    spark.createDataFrame([(q, *s) for q, own in seeds.items() for s in own], "query string, source string, weight double").createOrReplaceTempView("seeds")
    spark.createDataFrame([("a",), ("b",), ("no seeds",)], "query string").createOrReplaceTempView("asked_of")
    found = spark.sql("""
        SELECT * FROM nearest(TABLE(
          SELECT query, source, CAST(NULL AS STRING) AS target, weight FROM seeds
          UNION ALL SELECT query, id, NULL, NULL FROM asked_of, nodes
          UNION ALL SELECT query, source, target, NULL FROM asked_of, edges) PARTITION BY query)""").collect()  # fmt: skip
    for q, own in seeds.items():
        want = {r.id: round(r.score, 9) for r in graph.rank(nodes, edges, own).collect()}
        assert {r.id: round(r.score, 9) for r in found if r.query == q} == want
    assert {r.query for r in found} == {"a", "b"}


def test_search_for_given_terms(spark):
    docs = spark.createDataFrame([(k, "open " * (k % 3) + "store " * (k % 2)) for k in range(12)], "id int, text string")
    session.register_search(spark, search.stored(search.build_index(docs, "id", "text")))
    want = rows(spark.sql("SELECT * FROM search('store open store nowhere', 4)"))
    assert want and rows(spark.sql("SELECT * FROM search_terms(array('open', 'store', 'store'), 4)")) == want
    asked = spark.createDataFrame([(1, "OpenStore"), (2, ""), (3, None)], "n int, q string")
    got = spark.sql("SELECT n, term FROM {a}, LATERAL query_terms(q)", a=asked)
    assert rows(got) == [(1, "open"), (1, "store")]


def test_known_searches_weigh_their_words_alone(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices(["aa", "bb", "cc", "other"], [9, 4, 2, 5], k=rng.randrange(20)) + [f"rare{k % 9}"] * (k % 2))) for k in range(150)]
    index = search.stored(search.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text"))
    session.register_search(spark, index)
    asked = [["aa"], ["aa", "bb"], ["aa", "aa", "rare1"], ["bb", "rare1", "rare3"], ["nowhere"], []]
    frame = spark.createDataFrame([(k, sorted((t, words.count(t)) for t in {*words})) for k, words in enumerate(asked)] * 3, "n int, words array<struct<term: string, qtf: bigint>>")
    before = written()
    session.register_searches(spark, index, frame, 4)
    got = rows(spark.sql("SELECT DISTINCT n, s.* FROM {a} AS a, LATERAL best_of(a.words) AS s", a=frame))
    want = [(k, *r) for k, words in enumerate(asked) if words for r in rows(spark.sql(f"SELECT * FROM search('{' '.join(words)}', 4)"))]
    assert len(want) > 12 and got == sorted(want)
    held = next(p for p in written() if p not in before and "/held-" in p)
    assert {t for r in spark.read.parquet(held).collect() for t in r.held} == {"aa", "bb", "rare1", "rare3"}


def test_best_with_a_score_at_the_least_and_documents_met_by_two_words(spark, monkeypatch):
    weights = [("aa", "d1", 0.0009996), ("aa", "d2", 0.0010004), ("aa", "d3", 0.002), ("bb", "d3", 0.002), ("bb", "d9", 0.003)]
    monkeypatch.setattr(search, "weighed", lambda index, terms: spark.createDataFrame(weights, "term string, id string, w double"))
    index = search.Index(None, None, spark.createDataFrame([("aa", 3), ("bb", 2)], "term string, df bigint"), None)
    asked = spark.createDataFrame([([("aa", 1)],), ([("aa", 1), ("bb", 1)],)], "words array<struct<term: string, qtf: bigint>>")
    got = sorted((len(r.words), r.place, r.id, r.score) for r in search.best(index, asked, 2).collect())
    assert got == [(1, 1, "d3", 0.002), (1, 2, "d2", 0.001), (2, 1, "d3", 0.004), (2, 2, "d9", 0.003)]
