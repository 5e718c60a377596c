"""An index that follows its texts against one that is built anew."""

import random

from pyspark.sql import functions as F

from lumengraph.functions import text as T
from lumengraph.operators import search
from lumengraph.operators.text_index import TextIndex
from lumengraph.sources.store import Store


def best(spark, docs, query):
    frame = spark.createDataFrame([*docs.items()], "id string, text string")
    return [(r.id, round(r.score, 9)) for r in search.bm25(frame, "id", "text", query, 20).collect()]


def test_updates_equal_a_new_index(spark, tmp_path):
    rng = random.Random(5)
    words = ["open", "store", "read", "write", "cache", "row", "HTTPServer", "é", "x"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    docs = {f"d{k}": text() for k in range(100)} | {"none": None, "empty": ""}
    index = TextIndex(spark, str(tmp_path / "i"), segments=2)
    store = Store(spark, str(tmp_path / "i"))
    put = lambda: index.update(spark.createDataFrame([*docs.items()], "id string, text string").withColumn("hash", F.lit("z")), "id", "text")
    told = lambda q: [(r.id, round(r.score, 9)) for r in index.search(q, 20).collect()]
    assert put() == 102 and put() == 0 and store.numbers() == [1]
    assert told("open the cache open") == best(spark, docs, "open the cache open")
    rows = store.spark.read.parquet(f"{store.root}/{store.current().segments[0]}").count()
    docs["d7"] = "open open open cache"
    assert put() == 1 and len(store.current().segments) == 2
    assert store.spark.read.parquet(f"{store.root}/{store.current().segments[1]}").count() == 2  # only the changed text is written
    assert store.spark.read.parquet(f"{store.root}/{store.current().segments[0]}").count() == rows
    assert told("open the cache open") == best(spark, docs, "open the cache open")
    for k in range(0, 30, 3):
        del docs[f"d{k}"]
    docs["new"] = "write the store"
    assert put() == 1 and len(store.current().segments) == 1  # merged
    assert told("write http") == best(spark, docs, "write http") and told("") == [] and told("unknown") == []
    docs.clear()
    assert put() == 0 and told("open") == []


def test_counted_terms_of_empty_null_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "open store open"), (2, ""), (3, None), (3, "café Café"), (4, "x")], "i bigint, t string")
    rows = search.counted(search.tokenized(docs, "i", "t"))
    got = sorted((r.id, r.length, sorted((x.term, x.tf) for x in r.terms)) for r in rows.collect())
    assert got == [(1, 3, [("open", 2), ("store", 1)]), (2, 0, []), (3, 0, []), (3, 2, [("café", 2)]), (4, 0, [])]


def test_queries_of_the_same_words_are_searched_once_and_lose_nothing(spark):
    rng = random.Random(5)
    # Common words, rare ones, and a rare one that no document holds twice.
    docs = [(k, " ".join([*rng.choices(["aa", "bb", "cc"], [9, 5, 2], k=rng.randrange(30)), *([f"rare{k % 17}"] if k % 3 == 0 else []), *(["lone"] if k == 77 else [])])) for k in range(400)]
    index = search.stored(search.build_index(spark.createDataFrame(docs, "i bigint, t string"), "i", "t"))
    asked = [" ".join(rng.choices(["aa", "bb", "cc", "lone", "nowhere", *(f"rare{k}" for k in range(17))], k=rng.randrange(1, 6))) for _ in range(40)]
    asked += [f"{asked[0]} page{k}" for k in range(30)]
    queries = spark.createDataFrame([*enumerate(asked)], "query_id bigint, query string")
    got = {}
    for r in search.bm25_many(index, queries, 3).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, r.score))
    for k, query in enumerate(asked):
        if k < 12 or k > 66:
            scores = [(round(r.score, 6), r.id) for r in search.bm25_indexed(index, query.split(), 400).collect()]
            want = sorted(scores, key=lambda x: (-x[0], x[1]))[:3]
            assert sorted(got.get(k, [])) == [(n + 1, i, s) for n, (s, i) in enumerate(want)]
    # The common words alone have many documents; beside a rare word they are no longer looked up.
    sets = spark.createDataFrame([(1, [("aa", 1), ("lone", 1)]), (2, [("aa", 1), ("rare1", 1)])], "search bigint, words array<struct<term: string, qtf: bigint>>")
    weights = spark.createDataFrame([("aa", 0.1 + k / 1000) for k in range(9)] + [("rare1", 2.0 + k) for k in range(4)] + [("lone", 3.0)], "term string, w double")
    telling = {r.search: sorted(r.telling) for r in search._telling(sets, weights, 3).collect()}
    assert telling == {1: ["aa", "lone"], 2: ["rare1"]}


def test_tokens_of_any_text_are_those_of_the_plain_form(spark):
    rng = random.Random(3)
    letters = [*"aZbIiß.éÉµªºÿ 1-_9' \u0085 |!", "İ", "ı", "Σ", "σ", "ς", "أ", "ة", "ً", "字", "ǅ", "ⅷ", "Ⅷ", "\U0001d400"]
    texts = ["".join(rng.choices(letters, [4] * 8 + [1] * (len(letters) - 8), k=rng.randrange(24))) for _ in range(3000)]
    texts += ["".join(rng.choices("aBcI1 .|É", k=9)) for _ in range(1000)] + ["", None]
    spark.createDataFrame([(t,) for t in texts], "q string").createOrReplaceTempView("odd_texts")
    df = spark.sql(f"SELECT q, {T.spark_sql_tokens('q')} AS want FROM odd_texts").withColumn("got", T.tokens(F.col("q")))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_counted_terms_of_more_texts_than_a_slice(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd"], k=rng.randrange(6))) for _ in range(2 * search.SLICE + 7)]
    rows = search.tokenized(spark.createDataFrame([*enumerate(texts)], "i bigint, t string").coalesce(1), "i", "t")
    got = {r.id: (r.length, {x.term: x.tf for x in r.terms}) for r in search.counted(rows).collect()}
    assert got == {k: (len(t.split()), {w: t.split().count(w) for w in t.split()}) for k, t in enumerate(texts)}
