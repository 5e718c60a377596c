"""Lexical search: an inverted index and BM25."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lumengraph.functions import text as T
from lumengraph.runtime import dealt, durable

K1, B = 1.2, 0.75
LEAST_SCORE = 0.001
#: Texts whose terms are counted at once.
SLICE = 500
#: Different words of one query.
MOST_TERMS = 10_000


@dataclass
class Index:
    """Postings (id, term, tf), document lengths, document frequencies and corpus totals; `rows`, if given, is `counted` of the texts."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    rows: DataFrame | None = None


def tokenized(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, tokens) of composed texts, and `more` columns of theirs."""
    rows = T.nfc(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more), "text")
    return rows.select("id", T.tokens(F.col("text")).alias("tokens"), *more)


def counted(rows: DataFrame) -> DataFrame:
    """`rows(id, tokens, ...)` with `length` and `terms`, an array of (term, tf), for tokens: counted over a whole batch at once, without a shuffle."""
    rest = [StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "tokens"]
    terms = StructType().add("term", "string").add("tf", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By slices: the arrays of a whole batch's tokens would take many times its size.
        for part in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            lists = part.column(len(rest))
            codes = lists.flatten().dictionary_encode()
            words, n = codes.dictionary, max(len(codes.dictionary), 1)
            at = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) * n + codes.indices.to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(at, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(part.num_rows + 1, dtype=np.int64) * n)
            held = pa.StructArray.from_arrays([words.take(pa.array(pairs % n)), pa.array(tf.astype(np.int64))], ["term", "tf"])
            made = [pc.list_value_length(lists).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), held)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *made], names=[*part.schema.names[: len(rest)], "length", "terms"])

    schema = StructType([*rest, StructField("length", IntegerType()), StructField("terms", ArrayType(terms))])
    return rows.select(*[f.name for f in rest], "tokens").mapInArrow(count, schema)


def term_frequencies(rows: DataFrame) -> DataFrame:
    """(id, term, tf) of rows (id, tokens), one row an id."""
    return postings(counted(rows.select("id", "tokens")))


def postings(rows: DataFrame) -> DataFrame:
    """(id, term, tf) of `counted` rows."""
    return rows.select("id", F.explode("terms").alias("x")).select("id", "x.term", "x.tf")


def build_index(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """An index over texts, computed where it is used; `stored` writes it to serve many queries."""
    rows = tokenized(docs, id_col, text_col)
    lengths = rows.select("id", F.size("tokens").alias("length"))
    return Index(
        term_frequencies(rows),
        lengths,
        # One row per document and term leaves a task as one row per term.
        rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")),
        lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length")),
        counted(rows),
    )


def stored(index: Index) -> Index:
    """The same index from written tables: texts are cut once for all queries to come."""
    if index.rows is None:
        found, lengths = durable(index.postings, "postings"), durable(index.lengths, "lengths")
    else:
        rows = durable(index.rows, "documents")
        found, lengths = postings(rows), rows.select("id", "length")
    frequencies = durable(found.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    return Index(found, lengths, frequencies, lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length")), None if index.rows is None else rows)


def weighed(index: Index, terms: DataFrame) -> DataFrame:
    """(term, id, w): the weights of `terms(term, df)` in their documents. Where the index has rows of documents, each brings its length along."""
    if index.rows is None:
        met = index.postings.join(terms, "term").join(index.lengths, "id")
    else:
        met = index.rows.select("id", "length", F.explode("terms").alias("x")).select("id", "length", "x.term", "x.tf").join(terms, "term")
    one = weight(F.col("tf"), F.col("df"), F.col("length"), F.col("documents"), F.col("mean_length"))
    return met.join(F.broadcast(index.totals.limit(1))).select("term", "id", one.alias("w"))  # one row


def weight(tf: Column, df: Column, length: Column, documents: Column, mean: Column) -> Column:
    """BM25 weight of a term in a document; the mean length is floored at 1 in the ratio."""
    idf = F.log((documents - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(mean, F.lit(1.0))))


def query_terms(spark, query: str) -> list[str]:  # noqa: ANN001
    """Tokens of a query; repeated words stay and count as often."""
    return spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first().t


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int | None = None) -> DataFrame:
    """(id, score) above the least score, best first, ties by id; the first k, or all.

    One query needs no index: a pass counts the query's terms per document, and what it finds (a few
    numbers a document) is written once; the corpus totals and the scores come from there. Texts are
    cut into tokens once, and nothing is shuffled but a row per task.
    """
    terms = query_terms(docs.sparkSession, query)
    kinds = sorted(set(terms))
    rows = tokenized(docs, id_col, text_col)
    counts = [F.size(F.filter("tokens", _is(term))).alias(f"tf{n}") for n, term in enumerate(kinds)]
    found = durable(rows.select("id", F.size("tokens").alias("length"), *counts), "counts")
    totals = found.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(kinds))]).first()
    score = F.lit(0.0)
    for n, term in enumerate(kinds):
        one = weight(F.col(f"tf{n}"), F.lit(totals[f"df{n}"]), F.col("length"), F.lit(totals["n"]), F.lit(totals["mean"] or 0.0))
        score = score + F.when(F.col(f"tf{n}") > 0, one * terms.count(term)).otherwise(0.0)
    hits = found.select("id", score.alias("score")).where(F.col("score") > LEAST_SCORE).orderBy(F.desc("score"), "id")
    return hits if k is None else hits.limit(k)


def _is(term: str):  # noqa: ANN202
    return lambda t: t == term


def bm25_indexed(index: Index, terms: list[str], k: int) -> DataFrame:
    """The same from a stored index: the query's terms prune the postings."""
    spark = index.postings.sparkSession
    wanted = {t: terms.count(t) for t in terms}
    if len(wanted) > MOST_TERMS:
        raise ValueError(f"a query of more than {MOST_TERMS} different words")
    query = F.broadcast(spark.createDataFrame(list(wanted.items()), "term string, qtf int"))  # at most MOST_TERMS rows
    totals = F.broadcast(index.totals.limit(1))  # one row
    rows = index.postings.join(query, "term").join(index.frequencies.join(query.select("term"), "term"), "term").join(index.lengths, "id").join(totals)
    one = weight(F.col("tf"), F.col("df"), F.col("length"), F.col("documents"), F.col("mean_length")) * F.col("qtf")
    return rows.groupBy("id").agg(F.sum(one).alias("score")).where(F.col("score") > LEAST_SCORE).orderBy(F.desc("score"), "id").limit(k)


def bm25_many(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, place, id, score): for each of `queries(query_id, query)` its k best documents.

    Repeated words of a query count as often; ties go by id. Scores are compared to six decimals.
    """
    asked = T.nfc(queries.select("query_id", "query"), "query").select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(index.frequencies.select("term"), "term", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("words"))
    asked = durable(asked, "asked")
    return asked.join(best(index, asked, k), "words").select("query_id", "place", "id", "score")


def best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(words, place, id, score), written: the k best documents for each different array of (term, qtf) in `asked(words)`.

    Each is searched once, whatever the number of queries that come to it. A search meets the documents of
    its telling words alone, see `_telling`. A document's weights lie beside each of its postings, so
    that its score is worked out where it is met and only the k best of a task are shuffled.
    """
    sets = durable(asked.select("words").distinct().select(F.monotonically_increasing_id().alias("search"), "words"), "searches")
    terms = durable(sets.select(F.explode("words.term").alias("term")).distinct(), "terms")
    # A term's weight in a document is worked out once for all queries that ask for it. The terms are written, so that their size is known.
    each = weighed(index, durable(index.frequencies.join(terms, "term", "left_semi"), "asked_terms"))
    # Few weights make many scores: they are dealt over all tasks, however small.
    each = dealt(each, "id").groupBy("id", "term").agg(F.sum("w").alias("w"))
    held = durable(each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("held")), "held")
    postings = held.select("id", "held", F.explode("held").alias("term", "w"))
    searches = durable(_telling(sets, postings.select("term", "w"), k), "telling").withColumn("term", F.explode("telling"))
    score = F.aggregate("words", F.lit(0.0), lambda total, x: total + F.coalesce(F.try_element_at("held", x["term"]), F.lit(0.0)) * x["qtf"])
    met = searches.join(postings.drop("w"), "term").select("search", "id", score.alias("raw"))
    # A document is met by each telling word that it holds, with one score, and so has one place. What scores too little comes
    # last and goes after the ranking: a condition before it would work out each score twice.
    place = F.dense_rank().over(Window.partitionBy("search").orderBy(F.round("raw", 6).desc(), (F.col("raw") > LEAST_SCORE).desc(), "id"))
    first = met.withColumn("place", place).where((F.col("place") <= k) & (F.col("raw") > LEAST_SCORE)).distinct()
    # Written, so that a join can split the queries that come to the same words.
    return durable(first.join(sets, "search").select("words", "place", "id", F.round("raw", 6).alias("score")), "best")


def _telling(sets: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """`sets(search, words)` with `telling`: words one of which each of the k best documents holds.

    The k-th best weight of any of its words is a score that k documents reach. Words whose best weights
    together stay below that can't lift a document among them alone: the rest are telling.
    """
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w")))
    first = weights.withColumn("place", place).where(F.col("place") <= k)
    bounds = first.groupBy("term").agg(F.max("w").alias("most"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("w"))), F.lit(0.0)).alias("kth"))
    each = sets.select("search", "words", F.explode("words").alias("x")).select("search", "words", "x.term", "x.qtf").join(bounds, "term")
    limit = F.struct((F.col("most") * F.col("qtf")).alias("most"), "term")
    found = each.groupBy("search", "words").agg(F.array_sort(F.collect_list(limit)).alias("limits"), F.max(F.col("kth") * F.col("qtf")).alias("reached"))
    start = F.struct(F.lit(0.0).alias("most"), F.lit(0).alias("n"))
    # A margin for scores that are rounded to six decimals.
    low = lambda s, x: s["most"] + x["most"] < F.col("reached") - 1e-5
    step = lambda s, x: F.struct((s["most"] + x["most"]).alias("most"), (s["n"] + F.when(low(s, x), 1).otherwise(0)).alias("n"))
    n = F.aggregate("limits", start, step, lambda s: s["n"])
    return found.select("search", "words", F.slice("limits.term", n + 1, F.size("limits") - n).alias("telling"))
