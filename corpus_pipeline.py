"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

1. language ID: documents whose language is not told go;
2. n-gram Jaccard join: of every class of near-copies one document stays;
3. secret scans: every secret in a text is replaced by a mark;
4. mixing: every document is repeated, or left out, as its source's target weight asks;
5. best-fit packing: what is left is cut and packed into sequences of 2048 ids.

All stages but the last return the columns of documents.

Odd rows: a null or empty text, or one without letters, goes in the first stage; null and repeated ids
and exactly repeated rows are documents like any other until the second stage keeps one of each class
of near copies (the smallest id, a null one last, one row of those); null sources are a source of
their own in the fourth; a null language or count, and very long texts, pass whole. Other columns
pass untouched, but for `n_chars`, which is counted anew where secrets go. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumengraph.llm import language_id, mixing, ngram_join, packing, secrets
from lumengraph.runtime import discard, durable, prepare, table, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.recognised(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first three stages run code that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage has written goes as soon as its result is there."""
    docs, before = table(spark, sf_dir, "documents"), set(written())
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        discard(spark, [path for path in written()[:-1] if path not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
