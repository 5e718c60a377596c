"""A stored inverted index that follows its texts: only new and changed texts are cut into terms again.

Postings lie in segments, one for each update that found changes, sorted by term, so that a query reads
the row groups of its terms alone. The table of documents says which segment holds a document's
postings; those of changed and deleted documents go with that entry, without being rewritten.
Beyond `SEGMENTS` the segments are merged into one. The number of documents and their mean length come from
that table, document frequencies from the live postings of the query's terms, so scores are those of
an index that is built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import search
from lumengraph.runtime import discard, durable, prepare, written
from lumengraph.sources.files import StaleCacheError
from lumengraph.sources.store import SEGMENTS, Snapshot, Store

_DOCUMENTS = "path string, hash bigint, length int, segment string"


class TextIndex:
    """BM25 over texts that change; `root` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, segments: int = SEGMENTS) -> None:
        self.store, self.spark, self.most = Store(spark, root), spark, segments

    def update(self, docs: DataFrame, id_col: str, text_col: str) -> int:
        """Brings the index to the state of `docs`; returns how many texts were cut into terms.

        Ids are held as text and have to be distinct. A null text is empty. Nothing is written where nothing changed.
        """
        prepare(self.spark)
        before = written()
        try:
            last = self.store.current()
            known = self.store.table("files", last)
        except StaleCacheError:
            last, known = None, self.spark.createDataFrame([], _DOCUMENTS)
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("string").alias("path"), text.alias("text"), F.xxhash64(text).alias("hash"))
        held = known.select("path", F.col("hash").alias("old"))
        fresh = rows.join(held, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "text", "hash")
        cut = durable(search.counted(search.tokenized(fresh, "path", "text", "hash")), "cut")
        gone = durable(known.select("path").join(rows.select("path"), "path", "left_anti"), "gone")
        count = cut.count()
        if not count and last is not None and gone.isEmpty():
            discard(self.spark, [p for p in written() if p not in before])
            return 0
        segments = list(last.segments) if last else []
        new = self._written(search.postings(cut).withColumnRenamed("id", "path")) if count else None
        stays = known.join(gone, "path", "left_anti").join(cut.select(F.col("id").alias("path")), "path", "left_anti")
        files = stays.unionByName(cut.select(F.col("id").alias("path"), "hash", "length", F.lit(new).alias("segment")))
        folder = self.store.write(files, "files")
        segments += [new] if new else []
        if len(segments) > self.most:
            one = self._written(self.store.rows(Snapshot(0, {"files": folder}, segments)))
            folder = self.store.write(self.spark.read.parquet(f"{self.store.root}/{folder}").withColumn("segment", F.lit(one)), "files")
            segments = [one]
        self.store.commit({"files": folder}, segments)
        discard(self.spark, [p for p in written() if p not in before])
        return count

    def _written(self, postings: DataFrame) -> str:
        # By term and document, so that a term that all documents hold is shared out.
        return self.store.write(postings.repartitionByRange("term", "path").sortWithinPartitions("term", "path"), "rows")

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(id, score) of the best documents, best first, ties by id as text."""
        terms = search.query_terms(self.spark, query)
        last = self.store.current()
        files, rows = self.store.table("files", last), self.store.rows(last)
        if not terms or rows is None:
            return self.spark.createDataFrame([], "id string, score double")
        postings = durable(rows.where(F.col("term").isin(sorted(set(terms)))).select(F.col("path").alias("id"), "term", "tf"), "postings")
        lengths = files.select(F.col("path").alias("id"), "length")
        index = search.Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length")))
        return search.bm25_indexed(index, terms, k)
