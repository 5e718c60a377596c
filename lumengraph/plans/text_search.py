"""Queries over texts: tokens, BM25, folded search and grep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import text as T
from lumengraph.operators import grep, search
from lumengraph.operators.text_index import TextIndex
from lumengraph.runtime import scratch, table

QUERY = "the ention worthless erth the"
TOP = 30


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every page title part, with its frequency."""
    rows = search.tokenized(table(spark, sf_dir, "pages"), "page_id", "url")
    return search.term_frequencies(rows).select("id", "term", "tf")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over documents."""
    return search.term_frequencies(search.tokenized(table(spark, sf_dir, "documents"), "doc_id", "text"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over documents."""
    return search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text").frequencies


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: documents and mean length; documents without tokens count."""
    totals = search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text").totals
    return totals.select("documents", F.round("mean_length", 6).alias("mean_length"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a query."""
    hits = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY, TOP)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits by way of an index that is written first."""
    index = search.stored(search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text"))
    hits = search.bm25_indexed(index, search.query_terms(spark, QUERY), TOP)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4: the same hits by way of an index of the texts as they were, brought up to date: some were others, some not there, some more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    older = docs.where(k % 11 != 3).withColumn("text", F.when(k % 7 == 0, F.concat(F.lit("former words of stone "), "text")).otherwise(F.col("text")))
    gone = docs.where(k % 13 == 5).select((-k - 1).alias("doc_id"), "text")
    index = TextIndex(spark, scratch(spark, "index"))
    index.update(older.union(gone), "doc_id", "text")
    index.update(docs, "doc_id", "text")
    # Ties go by id as a number.
    return index.search(QUERY, docs.count()).select(F.col("id").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"), F.col("score").alias("exact")).orderBy(F.desc("exact"), "doc_id").limit(TOP).drop("exact")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12, K1: the three best documents for the address of every page, all searches at once."""
    index = search.stored(search.build_index(table(spark, sf_dir, "documents"), "doc_id", "text"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("query"))
    return search.bm25_many(index, pages, 3).select(F.col("query_id").alias("page_id"), F.col("place").cast("bigint").alias("place"), F.col("id").alias("doc_id"), "score")


def fold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold every word of a query."""
    part = table(spark, sf_dir, "part")
    return part.where(T.words_all_in("RİNG  SMALL", F.concat_ws(" ", "p_name", "p_brand", "p_type"))).select("p_partkey", "p_name")


def normalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 on names."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize(F.col("c_name")).alias("name"), T.fold_tr(F.col("c_mktsegment")).alias("segment"))


def camel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 on page markup titles."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.split_camel(F.concat(title, F.lit(" getHTTPResponse a_1B-c2D"))).alias("words"))


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines with numbers, ignoring case."""
    return grep.grep(table(spark, sf_dir, "documents"), "doc_id", "text", r"stupid|moron", ignore_case=True).select(F.col("id").alias("doc_id"), "line_no", "line")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines(F.col("text"))).cast("bigint").alias("n_lines"))


def indexed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a node is indexed by."""
    return table(spark, sf_dir, "part").select("p_partkey", grep.indexed_text("p_name", "p_brand", "p_type").alias("indexed"))


_TOKENS = f"SELECT doc_id AS id, {T.sql_tokens('text')} AS toks FROM documents"
_BM25 = f"""
WITH t AS (SELECT doc_id AS id, {T.sql_tokens("text")} AS toks FROM documents),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({T.sql_tokens(f"'{QUERY}'")}) AS term) GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t),
p AS (SELECT id, len(toks) AS length, unnest(toks) AS term FROM t),
f AS (SELECT id, length, term, count(*) AS tf FROM p JOIN q USING (term) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT id AS doc_id, round(score, 6) AS score FROM (
  SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * qtf) AS score
  FROM f JOIN d USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY id)
WHERE score > 0.001 ORDER BY score DESC, id LIMIT {TOP}
"""
_LINES = r"CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END"

QUERIES = {
    "tokenize_terms": tokenize_terms, "term_frequency": term_frequency, "document_frequency": document_frequency, "corpus_totals": corpus_totals,
    "bm25_topk": bm25_topk, "bm25_topk_indexed": bm25_topk_indexed, "bm25_incremental": bm25_incremental, "bm25_batch": bm25_batch, "fold_search": fold_search, "normalize_terms": normalize_terms,
    "camel_words": camel_words, "grep_lines": grep_lines, "line_counts": line_counts, "indexed_text": indexed_text,
}
ORACLES = {
    "tokenize_terms": f"SELECT id, term, count(*) AS tf FROM (SELECT page_id AS id, unnest({T.sql_tokens('url')}) AS term FROM pages) GROUP BY ALL",
    "term_frequency": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM ({_TOKENS})) GROUP BY ALL",
    "document_frequency": f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(toks) AS term FROM ({_TOKENS})) GROUP BY ALL",
    "corpus_totals": f"SELECT count(*) AS documents, round(avg(len(toks)), 6) AS mean_length FROM ({_TOKENS})",
    "bm25_topk": _BM25,
    "bm25_topk_indexed": _BM25,
    "bm25_incremental": _BM25,
    "bm25_batch": f"""
WITH t AS (SELECT doc_id AS id, {T.sql_tokens("text")} AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t),
q AS (SELECT page_id, term, count(*) AS qtf FROM (SELECT page_id, unnest({T.sql_tokens("url")}) AS term FROM pages) GROUP BY ALL),
f AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(toks) AS length, unnest(toks) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
r AS (SELECT page_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * qtf), 6) AS score, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * qtf) AS raw
      FROM q JOIN f USING (term) JOIN d USING (term) CROSS JOIN s GROUP BY ALL)
SELECT page_id, place, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, id) AS place FROM r WHERE raw > 0.001) WHERE place <= 3""",
    "fold_search": f"SELECT p_partkey, p_name FROM part WHERE list_aggregate(list_transform(regexp_split_to_array({T.sql_fold_tr("'RİNG  SMALL'")}, '\\s+'), lambda w: contains({T.sql_fold_tr("concat_ws(' ', p_name, p_brand, p_type)")}, w)), 'bool_and')",
    "normalize_terms": f"SELECT c_custkey, {T.sql_normalize('c_name')} AS name, {T.sql_fold_tr('c_mktsegment')} AS segment FROM customer",
    "camel_words": rf"SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' getHTTPResponse a_1B-c2D', '(\p{{Ll}}[^\p{{Lu}}\p{{Ll}}{T._SQL_SEPARATORS}{T._SQL_SPACES}]*)(\p{{Lu}})', '\1 \2', 'g') AS words FROM pages",
    "grep_lines": f"SELECT doc_id, n AS line_no, trim(l[n]) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(n) WHERE regexp_matches(l[n], '(?i)stupid|moron')",
    "line_counts": f"SELECT doc_id, len({_LINES}) AS n_lines FROM documents",
    "indexed_text": "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS indexed FROM part",
}
