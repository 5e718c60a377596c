"""N-gram Jaccard join by MinHash banding.

Words are the maximal runs of letters, digits and underscores of the lower-cased text; a text
without any is one word, the text itself. A document's set holds its runs of `n` words (all words
as one run where there are fewer). Two documents link if the Jaccard similarity of their sets is at
least `threshold`. Band and row counts are chosen so that a pair at the threshold meets in some band
with probability `recall`. Pairs that meet are verified on the full sets, in whole numbers.

Copies (equal word sequences) are one class and are compared once. Classes that meet in bands form
clusters. A cluster of up to `BLOCK` classes is verified whole, in one place. Larger ones are
verified bucket by bucket, a bucket cut into blocks of at most about `BLOCK` classes and every pair
of blocks being a task of its own, a pair counting only in the first bucket that its classes share.
Tasks return counts and local components, never pairs.

Rows are told apart by a number that they get when they are signed and that is written with them, so
nothing hangs on ids: an id may be null or stand for several texts.

Edge cases: null and empty texts link with nothing and are classes of their own. Repeated rows are
copies. A class in which every id is null has a null copy_of, and a component of such classes a null
class_id; both count in n_links like any other. Ids and other columns pass through untouched; extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumengraph.llm import arrow
from lumengraph.llm.arrow import slices
from lumengraph.llm.groups import Forest, components, join_links, linked
from lumengraph.runtime import durable, table

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 80
BLOCK = 1024
#: Rows that one verification task takes from small clusters.
TASK_ROWS = 1024
_BETWEEN, _MARK = r"[^\p{L}\p{N}_]+", "\x1f"
_U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band that reach the recall within the hash budget."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        meets = threshold**rows
        bands = 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meets))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


class Cut:
    """The words of texts: per text where its words' hashes lie, and the words in a row as one string."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern_regex(pc.utf8_lower(texts), _BETWEEN)
        # What stands before the first separator or after the last one is an empty string.
        self.joined = pc.utf8_trim(pc.binary_join(lists, _MARK), _MARK)
        coded = lists.flatten().dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], _U)
        at = coded.indices.to_numpy(zero_copy_only=False)
        filled = (pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[at]
        self.hashes = hashes[at[filled]]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(filled)])[ends]])
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def words(self, k: int) -> np.ndarray:
        """Hashes of a text's words; of the text itself where it holds none."""
        own = self.hashes[self.ends[k] : self.ends[k + 1]]
        if len(own):
            return own
        text = self.texts[k].as_py()
        return np.array([xxhash.xxh3_64_intdigest(text)] if text else [], _U)

    def key(self, k: int) -> bytes | None:
        """Digest of a text's words; equal for copies."""
        whole = self.joined[k].as_py() or self.texts[k].as_py()
        return hashlib.blake2b(whole.encode(), digest_size=16).digest() if whole else None


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words, in order and with repeats."""
    if not len(words):
        return words
    span = min(n, len(words))
    total = np.zeros(len(words) - span + 1, _U)
    for k in range(span):
        total = total * _U(0x9E3779B97F4A7C15) + words[k : k + len(total)]
    return _mix(total + _U(span))


def _signer(n: int, bands: int, rows: int, text: int):
    """Rows (doc, row, ck, bands): the document as it came, a number of its own, its class and its band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(20240229)
        a = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
        b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
        number = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, 0, inner=text):
            cut = Cut(part.column(0).field(text))
            keys = [cut.key(k) for k in range(len(cut))]
            found = np.zeros((len(cut), bands), np.int64)
            for k in range(len(cut)):
                s = shingles(cut.words(k), n)
                if not len(s):
                    continue
                low = np.full(bands * rows, ~_U(0))
                for at in range(0, len(s), 2048):
                    low = np.minimum(low, (a[:, None] * s[None, at : at + 2048] + b[:, None]).min(1))
                grid, key = low.reshape(bands, rows), number
                for r in range(rows):
                    key = _mix(key ^ grid[:, r])
                found[k] = key.view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.ravel()))
            numbers = pa.array(np.arange(row, row + len(cut)))
            row += len(cut)
            yield pa.RecordBatch.from_arrays([part.column(0), numbers, pa.array(keys, pa.binary()), listed], names=["doc", "row", "ck", "bands"])

    return sign


def _links(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the marked pairs reach the threshold; by set intersection, or by matrix products where pairs are many."""
    ratio = Fraction(str(threshold))
    top, low = ratio.numerator, ratio.denominator
    sa, sb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    pairs = pairs & (low * np.minimum(sa[:, None], sb[None, :]) >= top * np.maximum(sa[:, None], sb[None, :]))
    out = np.zeros(pairs.shape, bool)
    count = int(pairs.sum())
    if not count:
        return out
    if count <= 400:
        for i, j in zip(*np.nonzero(pairs), strict=True):
            both = len(np.intersect1d(a[i], b[j], assume_unique=True))
            out[i, j] = low * both >= top * (sa[i] + sb[j] - both)
        return out
    rows, cols = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
    fa, fb = np.concatenate([a[i] for i in rows]), np.concatenate([b[j] for j in cols])
    shared = np.intersect1d(fa, fb)
    both = np.zeros((len(rows), len(cols)), np.int64)

    def spread(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(sets), len(columns)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(columns, s)
            at[at == len(columns)] = 0
            grid[k, at[columns[at] == s]] = 1
        return grid

    for at in range(0, len(shared), 4096):
        columns = shared[at : at + 4096]
        both += (spread([a[i] for i in rows], columns) @ spread([b[j] for j in cols], columns).T).astype(np.int64)
    out[np.ix_(rows, cols)] = low * both >= top * (sa[rows][:, None] + sb[cols][None, :] - both)
    return out & pairs


def _verifier(n: int, threshold: float):
    def verify(part: pd.DataFrame) -> pd.DataFrame:
        one_each = part.drop_duplicates("ck")
        cut, out = Cut(pa.array(one_each["text"], pa.string())), []
        sets = {ck: np.unique(shingles(cut.words(k), n)) for k, ck in enumerate(one_each["ck"])}
        for _, group in part.groupby("bucket", sort=False):
            group = group.drop_duplicates(["ck"])
            if len(group) < 2:
                continue
            cks, copies = group["ck"].tolist(), group["copies"].to_numpy(float)
            block = group["block"].to_numpy()
            i, j = int(group["bi"].iat[0]), int(group["bj"].iat[0])
            rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(rows) or not len(cols):
                continue
            pairs = np.ones((len(rows), len(cols)), bool)
            if i == j:
                pairs = np.triu(pairs, 1)
            kept = group["kept"].tolist()
            if kept[0] is not None and len(kept[0]):
                pairs &= _first_here([kept[k] for k in rows], [kept[k] for k in cols], int(group["bucket"].iat[0]))
            links = _links([sets[cks[k]] for k in rows], [sets[cks[k]] for k in cols], pairs, threshold)
            if not links.any():
                continue
            counts = np.zeros(len(cks))
            np.add.at(counts, rows, links @ copies[cols])
            np.add.at(counts, cols, links.T @ copies[rows])
            forest = Forest(len(cks))
            join_links(forest, links, rows, cols)
            out += [(cks[k], int(counts[k]), cks[forest.root(int(k))]) for k in np.flatnonzero(counts)]
        return pd.DataFrame(out, columns=["ck", "links", "root"])

    return verify


def _first_here(left: list, right: list, bucket: int) -> np.ndarray:
    """Pairs whose smallest common bucket is this one."""
    earlier = sorted({x for k in (*left, *right) for x in k if x < bucket})
    at = {x: k for k, x in enumerate(earlier)}

    def spread(rows: list) -> np.ndarray:
        grid = np.zeros((len(rows), len(earlier)), np.float32)
        for k, row in enumerate(rows):
            grid[k, [at[x] for x in row if x < bucket]] = 1
        return grid

    if not earlier:
        return np.ones((len(left), len(right)), bool)
    return spread(left) @ spread(right).T == 0


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc, row, ck), and per class its label and its component's as (none, id, row), and n_links."""
    bands, rows = bands_for(threshold, recall)
    whole = docs.select(arrow.whole(docs).alias("doc"))
    schema = StructType([StructField("doc", whole.schema["doc"].dataType, False), *StructType.fromDDL("row bigint, ck binary, bands array<bigint>").fields])
    signed = durable(whole.mapInArrow(_signer(n, bands, rows, docs.columns.index("text")), schema), "signed")
    label = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row"))
    classes = signed.where("ck IS NOT NULL").groupBy("ck").agg(label.alias("label"), F.count("*").alias("copies"), F.min_by("bands", "row").alias("bands"), F.min("row").alias("shown"))
    classes = durable(classes, "classes")
    at = classes.select("ck", F.explode("bands").alias("bucket"))
    # Buckets with the same members are the same work: one of them stays.
    member = F.xxhash64("ck").cast("decimal(20,0)")
    sizes = at.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(member).alias("s1"), F.sum(F.xxhash64(F.lit(1), "ck").cast("decimal(20,0)")).alias("s2"), F.min("ck").alias("first")).where("size > 1")
    sizes = durable(sizes.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket"), F.min("first").alias("first")).select("bucket", "size", "first"), "buckets")
    met = durable(at.join(sizes, "bucket"), "met")
    clusters = components(met.select(F.col("ck").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "ck").withColumnRenamed("component", "cluster")
    clusters = durable(clusters, "clusters")
    large = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > block).select("cluster")
    small = clusters.join(large, "cluster", "left_anti")
    tasks = max(1, math.ceil(clusters.count() / TASK_ROWS))
    no_kept = F.lit(None).cast("array<bigint>")
    whole = small.select("ck", F.xxhash64("cluster").alias("bucket"), no_kept.alias("kept"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.lit(0).alias("block"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    wide = met.join(clusters.join(large, "cluster"), "ck").select("ck", "bucket", "size")
    kept = wide.groupBy("ck").agg(F.collect_set("bucket").alias("kept"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    wide = wide.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "ck"), F.col("blocks")).cast("int"))
    wide = wide.join(kept, "ck").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("ck", "bucket", "kept", F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(tasks))).otherwise(F.col("bucket")).alias("task"), "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    plan = whole.unionByName(wide)
    shown = classes.join(clusters.select("ck"), "ck", "left_semi").select("ck", "copies", F.col("shown").alias("row"))
    texts = shown.join(signed.select("row", F.col("doc.text").alias("text")), "row").drop("row")
    found = plan.join(texts, "ck").groupBy("task", "bi", "bj").applyInPandas(_verifier(n, threshold), "ck binary, links bigint, root binary")
    return signed.select("doc", "row", "ck"), linked(classes.select("ck", "label", "copies"), found)


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, copy_of, n_links and class_id.

    copy_of is the smallest id with the same words; n_links counts the other documents whose
    similarity reaches the threshold; class_id is the smallest id reachable over links.
    """
    signed, classes = _joined(docs.select("doc_id", "text"), n, threshold, recall, block)
    own = F.col("doc.doc_id").alias("doc_id")
    none = signed.where("ck IS NULL").select(own, own.alias("copy_of"), F.lit(0).cast("bigint").alias("n_links"), own.alias("class_id"))
    some = signed.where("ck IS NOT NULL").join(classes, "ck")
    return some.select(own, F.col("label.id").alias("copy_of"), F.col("n_links").cast("bigint").alias("n_links"), F.col("top.id").alias("class_id")).unionByName(none)


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the near-copies: of every class the row with the smallest id stays, a null id being the last.

    Of rows with that id one stays. Rows whose text is null or empty stay.
    """
    signed, classes = _joined(docs, n, threshold, RECALL, BLOCK)
    kept = classes.where("label = top").select(F.col("label.row").alias("row")).unionByName(signed.where("ck IS NULL").select("row"))
    return signed.join(kept, "row", "left_semi").select("doc.*")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document: runs of five words, similarity of 0.8 or more."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLES: dict[str, str] = {}
