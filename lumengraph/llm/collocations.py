"""Phrase collocations by hierarchical pair naming.

Words are counted first. A word's name is a keyed hash of its language and itself; that no other word
has the name of a frequent one is checked over all words, and else another key is taken. Then texts
become blocks: the frequent words of some texts of one language as one row of local numbers, with a 0
wherever a piece or a run of frequent words ends, beside the names by number. From there on every
level does the same: two adjacent frequent phrases of k - 1 words, which overlap in all but two, are a
pair, numbered within the block, counted over all blocks and, if it is frequent, named by a join of its
halves with the names of the level before. A place whose phrase is rare breaks the row, as no longer
phrase there can be frequent.

Most pairs of frequent words are rare. So a level is counted twice: first all phrases in a fixed number
of counters, by a hash of their names, of which a task sends few bytes each, packed and in order; then
exactly, by their names, and only those whose counter comes to the least count. A counter holds at least what each of
its phrases does, so none that is frequent is missed.

The pair that a name stands for is also its pointer to both parents. Following left pointers gives
the counts of a phrase's beginnings, right pointers those of its ends, which is all that the cuts
need; followed from the longer phrase, they tell what it takes up. As a phrase is at least as frequent
as any phrase that holds it, what some longer phrase takes up is taken up by one that is a word longer.

A block's rows are bounded by `BLOCK` bytes of text: longer texts are cut where a piece ends (only a
piece that is longer itself stays whole). Names needn't go back to the blocks: which of their words and
phrases may be frequent they see from a bit map of fixed size over the hashes of the frequent ones. A
false hit makes an entry that cannot reach the least count, as it holds a rarer phrase, or that the join
drops.

Edge cases: a null text is empty; a null language is `und`. Repeated rows count each. Ids and other
columns are not read. Counts are exact integers, scores are cut down from exact quotients of decimals.
An empty table, or one without a frequent phrase, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm.arrow import slices
from lumengraph.runtime import discard, durable, prepare, table, written

LONGEST, LEAST, WITHIN, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
UNKNOWN = "und"
#: Bytes of text in a block, and rows.
BLOCK, BLOCK_ROWS = 8 << 20, 1 << 16
#: Bits of the map over frequent entries (2 MB), and candidates that are ranked together at first.
BITS, RANKED = 1 << 24, 50_000
#: Counters of a level (a bit each, 32 MB, comes back), those that are summed at a time, and phrases that a task gathers.
COUNTERS, PAGE, GATHERED = 1 << 28, 1 << 18, 1 << 22
#: Bits of a word's name.
NAME = 64
# Ends of pieces, and gaps between words.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KIND[list(b" \t")] = 1

_WORD = "lang string, word string, n bigint"
_BLOCK = "seq binary, ids binary"
_COUNTS = "page bigint, low binary, mid binary, high binary, n binary"


def _packed(seq: np.ndarray) -> bytes:
    """Local numbers byte by byte: all lowest bytes, then the next, so that high zeros compress away."""
    return seq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _collapsed(seq: np.ndarray) -> np.ndarray:
    """Without entries that have no neighbour and with one 0 between what remains."""
    held = np.concatenate([[False], seq > 0, [False]])
    held[1:-1] &= held[:-2] | held[2:]
    keep = held[1:-1] | held[:-2]  # an entry, or the first place after one
    return np.where(held[1:-1], seq, 0)[keep]


def _encoded(data: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row of local numbers (from 1, frequent ones first; 0 between pieces), the words by number, their counts."""
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], np.diff(edges)[::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    coded = words.dictionary_encode()
    own = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(own, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    at = np.arange(len(own)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    seq = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint32)
    seq[at] = number[own]
    return seq, coded.dictionary.take(pa.array(order)), counts[order]


def _parts(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The bytes of texts, A-Z in lower case, each with a line end; more than `size` is cut after the end of a piece."""
    kind = pa.large_string()
    ended = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts.cast(kind), "")), pa.scalar("", kind), pa.scalar("\n", kind))
    bounds = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    at = 0
    while len(data) - at > size:
        stops = np.flatnonzero(_KIND[data[at : at + size]] == 2)
        if len(stops):
            to = at + int(stops[-1]) + 1
        else:
            to = at + size
            while _KIND[data[to - 1]] != 2:
                to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def _encoded_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray]]:
    """Rows (lang, text) to blocks: language, row of local numbers, words by number, their counts."""
    for part in slices(batches, 1, BLOCK_ROWS, size):
        langs = part.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            for data in _parts(part.column(1).filter(pc.equal(langs.indices, k)), size):
                seq, words, counts = _encoded(data)
                if len(words):
                    yield lang, seq, words, counts


def _words(size: int):  # noqa: ANN202
    """Rows (lang, text) to the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, words, counts in _encoded_parts(batches, size):
            columns = [pa.array([lang] * len(counts), pa.string()), words.cast(pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    return run


def _names(langs: pa.Array | pa.Scalar, words: pa.Array, key: int, bits: int) -> np.ndarray:
    """Names of words, which hold no blanks themselves, of so many bits."""
    kind = pa.large_binary()
    whole = pc.binary_join_element_wise(langs.cast(kind), words.cast(kind), pa.scalar(b" ", kind))
    hashed = pd.util.hash_array(whole.to_numpy(zero_copy_only=False), hash_key=f"{key:016x}", categorize=False)
    return (hashed >> np.uint64(64 - bits)).view(np.int64)


def _blocks(size: int, key: int, name: int, bits: np.ndarray, spark: SparkSession):  # noqa: ANN202
    """Rows (lang, text) to blocks of the words whose bit is set."""
    held = spark.sparkContext.broadcast(bits)  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, seq, words, _ in _encoded_parts(batches, size):
            ids = _names(pa.scalar(lang), words, key, name)
            frequent = _held(held.value, [ids])
            short = np.concatenate([[0], np.where(frequent, np.cumsum(frequent), 0)]).astype(np.uint32)
            seq = _collapsed(short[seq])
            if len(seq):
                yield pa.RecordBatch.from_arrays([pa.array([_packed(seq)], pa.binary()), pa.array([ids[frequent].astype("<i8").tobytes()], pa.binary())], names=["seq", "ids"])

    return run


def _places(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Which of so many bits is an entry's, entries given by columns of 64-bit numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _held(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    places = _places(columns, 8 * len(bits))
    return (bits[places >> 3] >> (places & 7) & 1).astype(bool)


def _bits(entries: DataFrame) -> np.ndarray:
    """One bit for each of the entries, as packed bytes of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS // 8, np.uint8)
        for part in batches:
            at = _places([c.to_numpy() for c in part.columns], 8 * len(held))
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        pages = np.flatnonzero(held.reshape(-1, 1024).any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array([held[page * 1024 : page * 1024 + 1024].tobytes() for page in pages], pa.binary())], names=["page", "held"])

    def joined(part: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in part.column("held").to_pylist()])
        return pa.table({"page": part.column("page").slice(0, 1), "held": pa.array([held.tobytes()], pa.binary())})

    out = np.zeros(BITS // 8, np.uint8)
    for row in entries.mapInArrow(run, "page bigint, held binary").groupBy("page").applyInArrow(joined, "page bigint, held binary").collect():  # BITS bits at most
        out[row.page * 1024 : row.page * 1024 + 1024] = np.frombuffer(row.held, np.uint8)
    return out


def _likely(entries: DataFrame, bits: np.ndarray) -> DataFrame:
    """Entries (id) whose bit is set: all frequent ones and few others."""
    held = entries.sparkSession.sparkContext.broadcast(bits)  # BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(_held(held.value, [part.column(0).to_numpy()])))

    return entries.mapInArrow(run, entries.schema)


def _named_words(rows: DataFrame, least: int, block: int) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """Words per language (lang, n), frequent words (id, lang, word, a), the bits of their names, the names' key."""
    spark, name = rows.sparkSession, NAME
    counted = durable(rows.mapInArrow(_words(block), _WORD).groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    place = written()[-1]
    total = durable(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    for key in count():

        def run(batches: Iterator[pa.RecordBatch], key: int = key) -> Iterator[pa.RecordBatch]:
            for part in batches:
                ids = pa.array(_names(part.column(0), part.column(1), key, name))
                yield pa.RecordBatch.from_arrays([ids, *part.columns], names=["id", "lang", "word", "a"])

        named = counted.mapInArrow(run, "id bigint, lang string, word string, a bigint")
        names = durable(named.where(F.col("a") >= least), "names1")
        bits = _bits(names.select("id"))
        # A frequent word's name that another word has, frequent or not; names that only rare words share do no harm.
        twice = _likely(named.select("id"), bits).groupBy("id").count().where("count > 1")
        if twice.join(names.select("id"), "id").isEmpty():
            discard(spark, [place])
            return total, names, bits, key
        discard(spark, [written()[-1]])
    raise AssertionError


def _phrases(batches: Iterator[pa.RecordBatch], size: int, bits: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Blocks (seq, ids) to their distinct phrases, one block at a time."""
    for part in batches:
        for row in range(part.num_rows):
            packed, ids = (part.column(c)[row].as_buffer() for c in (0, 1))
            yield _counted(_unpacked(packed), np.frombuffer(ids, "<i8"), size, bits)


def _summed(some: list[tuple[np.ndarray, np.ndarray]], least: int, page: int) -> pa.RecordBatch:
    """Counters and what they gain, put together: a row for each page, its counters in order as gaps, in three planes of bytes."""
    places, counts = (np.concatenate(x) for x in zip(*some, strict=True))
    order = np.argsort(places)
    places = places[order].astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    sums = np.minimum(np.add.reduceat(counts[order], first, dtype=np.int64), least)
    places = places[first]
    pages = places // page
    start = np.flatnonzero(np.diff(pages, prepend=-1))
    gaps = np.diff(places, prepend=0)
    gaps[start] = places[start] % page
    planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _paged(pages, {"low": planes[:, 0], "mid": planes[:, 1], "high": planes[:, 2], "n": sums.astype(_kind(least))})


def _paged(pages: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each page, equal ones together, with the bytes of its part of every column."""
    start = np.flatnonzero(np.diff(pages, prepend=-1))
    bounds = np.append(start, len(pages)).astype(np.int32)
    made = [pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds * c.itemsize), pa.py_buffer(np.ascontiguousarray(c).view(np.uint8))]) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(pages[start]), *made], names=["page", *columns])


def _kind(least: int) -> np.dtype:
    """Bytes for a count up to `least`, which is all that is told apart."""
    return np.min_scalar_type(least).newbyteorder("<")


def _counters(blocks: DataFrame, size: int, bits: list[np.ndarray], least: int) -> np.ndarray:
    """A bit for each counter: whether the phrases of `size` words that it stands for come to `least`."""
    held = blocks.sparkSession.sparkContext.broadcast(bits)  # BITS bits a level
    counters, page, gathered = COUNTERS, min(COUNTERS, PAGE), GATHERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for columns, counts in _phrases(batches, size, held.value):
            some.append((_places(columns, counters).astype(np.uint32), np.minimum(counts, least).astype(_kind(least))))
            n += len(counts)
            if n >= gathered:
                yield _summed(some, least, page)
                some, n = [], 0
        if n:
            yield _summed(some, least, page)

    def joined(part: pa.Table) -> pa.Table:
        total = np.zeros(page, np.int64)
        for row in range(part.num_rows):
            low, mid, high, n = (np.frombuffer(part.column(c)[row].as_buffer(), kind) for c, kind in zip(("low", "mid", "high", "n"), (np.uint8, np.uint8, np.uint8, _kind(least)), strict=True))
            total[np.cumsum(low + (mid.astype(np.int64) << 8) + (high.astype(np.int64) << 16))] += n
        return pa.table({"page": part.column("page").slice(0, 1), "held": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(counters // 8, np.uint8)
    for row in blocks.mapInArrow(run, _COUNTS).groupBy("page").applyInArrow(joined, "page bigint, held binary").collect():  # COUNTERS bits at most
        out[row.page * (page // 8) : (row.page + 1) * (page // 8)] = np.frombuffer(row.held, np.uint8)
    return out


def _merged(columns: list[np.ndarray], counts: np.ndarray, order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Entries in an order, equal neighbours as one, with the sum of their counts, and where in the order they were first."""
    columns = [c[order] for c in columns]
    other = np.ones(len(order), bool)
    other[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(other)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first), first


def _named(blocks: DataFrame, size: int, bits: list[np.ndarray], least: int) -> DataFrame:
    """Frequent phrases of `size` words (id, w1, ..., a), written.

    bits: of the frequent phrases of 2, 3, ... words; single words are all frequent. A task puts its
    blocks' phrases together, `GATHERED` / 4 at a time, and sends them in pages by a hash.
    """
    held = blocks.sparkSession.sparkContext.broadcast([*bits, _counters(blocks, size, bits, least)])  # BITS bits a level, and COUNTERS bits
    names, pages, gathered = [f"w{k}" for k in range(1, size + 1)], max(1, COUNTERS // PAGE), GATHERED // 4

    def paged(some: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([x[0][k] for x in some]) for k in range(size)]
        places = _places(columns, 1 << 40)
        order = np.argsort(places)
        columns, counts, first = _merged(columns, np.concatenate([x[1] for x in some]), order)
        return _paged(places[order][first] * pages >> 40, {c: x.astype("<i8") for c, x in zip([*names, "n"], [*columns, counts], strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for columns, counts in _phrases(batches, size, held.value):
            keep = _held(held.value[-1], columns)
            some.append(([c[keep] for c in columns], counts[keep]))
            n += len(some[-1][1])
            if n >= gathered:
                yield paged(some)
                some, n = [], 0
        if n:
            yield paged(some)

    def joined(part: pa.Table) -> pa.Table:
        *columns, counts = (np.concatenate([np.frombuffer(part.column(c)[row].as_buffer(), "<i8") for row in range(part.num_rows)]) for c in (*names, "n"))
        columns, counts, _ = _merged(columns, counts, np.lexsort(columns))
        keep = counts >= least
        return pa.table({c: x[keep] for c, x in zip([*names, "a"], [*columns, counts], strict=True)})

    sent = blocks.mapInArrow(run, ", ".join(["page bigint", *(f"{c} binary" for c in (*names, "n"))]))
    found = sent.groupBy("page").applyInArrow(joined, ", ".join(f"{c} bigint" for c in (*names, "a")))
    return durable(found.select(F.monotonically_increasing_id().alias("id"), *names, "a"), f"names{size}")


def _counted(seq: np.ndarray, ids: np.ndarray, size: int, bits: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of the words of a block's distinct phrases, one column a place, and their counts."""
    # Where a phrase of a word less begins: its number, from 1; 0 for none.
    own = seq.astype(np.int64)
    for k in range(2, size + 1):
        at = np.flatnonzero((own[:-1] > 0) & (own[1:] > 0))
        # A phrase is told by its first half and its last word.
        keys = own[at] * (len(ids) + 1) + seq[at + k - 1]
        _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        columns = [ids[seq[at[first] + j] - 1] for j in range(k)]
        if k == size:
            return columns, counts
        number = np.where(_held(bits[k - 2], columns), np.arange(1, len(first) + 1), 0)
        after = np.zeros(max(0, len(own) - 1), np.int64)
        after[at] = number[back]
        own = after
    raise ValueError(size)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang", block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and for 1 to `longest` words the frequent phrases.

    Of a phrase: id, lang, phrase, last (word), a (count), heads and tails (counts of its first and of
    its last 1, 2, ... words), and from two words on l and r, the ids of its two parents.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    total, names, held, key = _named_words(rows, least, block)
    blocks = durable(rows.mapInArrow(_blocks(block, key, NAME, held, spark), _BLOCK), "blocks", compression="zstd")
    place = written()[-1]
    one = F.array("a")
    found = [names.select("id", F.array("id").alias("words"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", one.alias("heads"), one.alias("tails"))]
    bits: list[np.ndarray] = []
    for size in range(2, longest + 1):
        key = [f"w{k}" for k in range(1, size + 1)]
        names = _named(blocks, size, bits, least)
        if size < longest:
            bits.append(_bits(names.select(*key)))
        # A name is joined with those of its halves: its parents.
        left = found[-1].select(F.col("id").alias("l"), F.col("words").alias("first"), "lang", "phrase", "heads")
        right = found[-1].select(F.col("id").alias("r"), F.col("words").alias("rest"), "last", "tails")
        pairs = names.select("id", "a", F.array(*key).alias("words"), F.array(*key[:-1]).alias("first"), F.array(*key[1:]).alias("rest"))
        phrase, heads, tails = F.concat_ws(" ", "phrase", "last").alias("phrase"), F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails")
        found.append(durable(pairs.join(left, "first").join(right, "rest").select("id", "words", "lang", phrase, "last", "a", heads, tails, "l", "r"), f"phrases{size}"))
    discard(spark, [place])
    return total, found


def scored(phrases: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """`phrases` of `size` words with l, r and score of the cut that scores lowest, the earliest of equal ones."""
    cuts = []
    for k in range(1, size):
        first, rest = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
        score = F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * {scale} AS DECIMAL(38, 0)) DIV CAST(heads[{k - 1}] + tails[{size - k - 1}] AS DECIMAL(20, 0))")
        cuts.append(F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    return phrases.withColumn("cut", best).select("id", "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, **more) -> tuple[DataFrame, DataFrame]:
    """Words per language, and every candidate that no longer phrase takes up: lang, phrase, a, l, r, score.

    A longer phrase takes a candidate up that it holds if it comes to `within` percent of its count.
    """
    total, found = levels(docs, longest, least, **more)
    out = None
    for size in range(2, longest + 1):
        rows = scored(found[size - 1], size)
        if size < longest:
            longer = found[size]
            held = longer.select(F.col("l").alias("id"), "a").union(longer.select(F.col("r").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("most"))
            exact = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(10,0)")
            rows = rows.join(held, "id", "left").where(F.col("most").isNull() | (exact("most", 100) < exact("a", within)))
        rows = rows.select("lang", "phrase", "a", "l", "r", "score")
        out = rows if out is None else out.unionByName(rows)
    return total, durable(out, "candidates")


def top_phrases(docs: DataFrame, top: int = TOP, **more) -> DataFrame:
    """The first `top` candidates of every language: lang, rank, phrase, a, l, r, n, score.

    Candidates of a language are ranked in as many parts as their number asks for, and the first of
    each part together.
    """
    total, found = collocations(docs, **more)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = found.groupBy("lang").agg(F.ceil(F.count("*") / RANKED).alias("parts"))
    salted = found.join(parts, "lang").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.col("parts")))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language in the documents."""
    return top_phrases(table(spark, sf_dir, "documents"))


_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS MATERIALIZED (
  SELECT lang, w, len(w) AS size FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)) WHERE len(w) > 0),
total AS (SELECT lang, sum(size)::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, size - k + 2)) AS i FROM p, range(1, {LONGEST + 1}) ks(k) WHERE size >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score, c.cut FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ones AS (
  SELECT lang, a AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100::HUGEINT * i.longer >= {WITHIN}::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": _SQL}
