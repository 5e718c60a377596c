"""Language identification by word-first backoff.

Words are the maximal runs of letters of the lower-cased text. A word known from training scores by
its log frequency in each language. An unseen word is scored by its character n-grams (with a mark
at either end), the longest known first: each place takes the longest n-gram that training knows,
down to single characters, and the word scores the mean of its places. The language with the highest
sum wins; `score` is its share among the languages after the sums are divided by the square root of
the number of words, so that it says how clearly the mean word speaks for it and not only how long
the text is.

Training counts words and n-grams per language over at most about `TRAIN_DOCS` labelled documents, each
language having an equal part of that number (its rows that hash below a bound that follows from
their count; all of them where they are fewer), so that a rare language is not starved. Each language
likewise has an equal part of the model's `WORDS` words and of its `GRAMS` n-grams of each length, its
own most frequent ones, whatever other languages write. The model's size is bounded by these numbers
times the number of languages.

Edge cases: a null text, or one without letters, gets `und` and score 0. Rows without a language
are not learned from. With nothing to learn from every text is `und`. Equal sums go to the language
that sorts first. Repeated rows are scored each. Ids and other kept columns of any type pass through
untouched. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm import arrow
from lumengraph.runtime import durable, table

#: Documented bounds of the training sample and of the model, shared evenly by the languages.
TRAIN_DOCS, WORDS, GRAMS = 20_000, 60_000, 40_000
LONGEST = 4
UNDETERMINED = "und"
#: A language is taken as told from this score on.
LEAST = 0.5
#: Numbers that a step of the scoring holds: places by languages.
_HELD = 1 << 22


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


@dataclass
class Model:
    """Log frequencies per language of words and n-grams.

    An n-gram's key holds the numbers of its characters, 16 bits each, so the keys of a length are
    one sorted array.
    """

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length - 1
    listed: pa.Array = field(init=False)
    word_logs: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)
    keys: list[np.ndarray] = field(init=False)
    gram_logs: np.ndarray = field(init=False)
    firsts: list[int] = field(init=False)

    def __post_init__(self) -> None:
        wide = len(self.languages)
        self.listed = pa.array(list(self.words), pa.large_string())
        self.word_logs = np.array(list(self.words.values()), float).reshape(len(self.words), wide)
        self.letters = np.array(sorted({ord(c) for one in self.grams for g in one for c in g})[: (1 << 16) - 1], np.uint32)
        self.keys, logs, self.firsts = [], [np.zeros((1, wide))], []
        at = 1  # row 0 is for places without any known n-gram
        for k, one in enumerate(self.grams, 1):
            numbers = self.numbers("".join(one)).reshape(-1, k)
            known = (numbers > 0).all(1)
            keys = sum((numbers[:, j] << np.uint64(16 * j) for j in range(k)), np.zeros(len(numbers), np.uint64))
            order = np.flatnonzero(known)[np.argsort(keys[known])]
            self.keys.append(keys[order])
            self.firsts.append(at)
            logs.append(np.array(list(one.values()), float).reshape(len(one), wide)[order])
            at += len(order)
        self.gram_logs = np.concatenate(logs)

    def numbers(self, text: str) -> np.ndarray:
        """Number of each character among those of the n-grams, from 1; 0 for others."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(self.letters):
            return np.zeros(len(codes), np.uint64)
        at = np.searchsorted(self.letters, codes)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == codes, at + 1, 0).astype(np.uint64)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean over the places of each word of the longest known n-gram's log frequencies."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        numbers = self.numbers("".join(f"^{w}$" for w in words))
        ends = np.cumsum(sizes)
        row = np.zeros(len(numbers), np.int64)
        room = np.repeat(ends, sizes) - np.arange(len(numbers))
        for k in range(LONGEST, 0, -1):
            keys = self.keys[k - 1]
            open_ones = np.flatnonzero((row == 0) & (room >= k))
            if not len(keys) or not len(open_ones):
                continue
            own, whole = np.zeros(len(open_ones), np.uint64), np.ones(len(open_ones), bool)
            for j in range(k):
                one = numbers[open_ones + j]
                own |= one << np.uint64(16 * j)
                whole &= one > 0
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            hit = (keys[at] == own) & whole
            row[open_ones[hit]] = self.firsts[k - 1] + at[hit]
        places = np.add.reduceat(row > 0, ends - sizes, dtype=np.int64)
        return _sums(self.gram_logs, row, ends) / np.maximum(places, 1)[:, None]

    def rows(self, words: pa.Array) -> np.ndarray:
        """Log frequencies of distinct words, each less the word's greatest; 0 for the empty word."""
        at = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), len(self.languages)))
        seen = at >= 0
        out[seen] = self.word_logs[at[seen]]
        new = np.flatnonzero(~seen & (pc.utf8_length(words).to_numpy(zero_copy_only=False) > 0))
        if len(new):
            out[new] = self.unseen(words.take(pa.array(new)).to_pylist())
        return out - out.max(1, keepdims=True)


def _sums(logs: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of `logs[at]` over runs that end at `ends` (none empty), some runs at a time; a long run by its counts."""
    out = np.zeros((len(ends), logs.shape[1]))
    most = max(1, _HELD // max(1, logs.shape[1]))
    k = 0
    while k < len(ends):
        first = int(ends[k - 1]) if k else 0
        if ends[k] - first > most:
            out[k] = np.bincount(at[first : ends[k]], minlength=len(logs)) @ logs
            k += 1
            continue
        to = int(np.searchsorted(ends, first + most, "right"))
        starts = np.concatenate([[0], ends[k : to - 1] - first]).astype(np.int64)
        out[k:to] = np.add.reduceat(logs[at[first : ends[to - 1]]], starts, axis=0)
        k = to
    return out


def words_of(texts: list) -> pa.Array:
    """Per text its words; what stands before the first or after the last one is an empty word."""
    return pc.split_pattern_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), r"\P{L}+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of rows (lang, text), summed per batch."""
    for part in arrow.slices(batches, 1):
        lists = words_of(part.column(1).to_pylist())
        langs = part.column(0).dictionary_encode()
        named = langs.indices.to_numpy()[np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        coded = lists.flatten().dictionary_encode()
        wide = np.int64(max(1, len(coded.dictionary)))
        pairs, times = np.unique(named * wide + coded.indices.to_numpy(), return_counts=True)
        words = coded.dictionary.take(pa.array(pairs % wide)).cast(pa.string())
        found = pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pairs // wide)), words, pa.array(times)], names=["lang", "key", "n"])
        yield found.filter(pc.greater(pc.utf8_length(words), 0))


def grams_of(words: list[str], times: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
    """The distinct runs of k characters in the marked words, and how often they occur."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    letters, own = np.unique(codes, return_inverse=True)
    if len(letters) >= 1 << 16 and len(words) > 1:
        half = len(words) // 2
        (a, x), (b, y) = grams_of(words[:half], times[:half], k), grams_of(words[half:], times[half:], k)
        return a + b, np.concatenate([x, y])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    at = np.flatnonzero(room >= k)
    keys = sum((own[at + j].astype(np.uint64) << np.uint64(16 * j) for j in range(k)), np.zeros(len(at), np.uint64))
    found, back = np.unique(keys, return_inverse=True)
    text = np.stack([letters[(found >> np.uint64(16 * j)) & np.uint64(0xFFFF)] for j in range(k)], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    counts = np.bincount(back, np.repeat(times, sizes)[at], len(found)).astype(np.int64)
    return [text[i : i + k] for i in range(0, len(text), k)], counts


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of rows (lang, key, n) of words: kind is the n-gram's length, summed per batch."""
    for part in batches:
        langs = part.column(0).dictionary_encode()
        own, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        for k, lang in enumerate(names):
            some = part.filter(pa.array(own == k))
            words, times = some.column(1).to_pylist(), some.column(2).to_numpy()
            for kind in range(1, LONGEST + 1):
                keys, counts = grams_of(words, times, kind)
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "key", "n"])


def sampled(labelled: DataFrame, most_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of the rows that are learned from: of each language an equal part of `most_docs`."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    each = max(1, most_docs // max(1, len(sizes)))
    below = F.lit(0)
    if any(n > each for n in sizes.values()):
        bounds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 30)))])
        below = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) - bounds[F.col("lang")]
    return usable.where(below <= 0).select("lang", "text")


def train(labelled: DataFrame, most_docs: int = TRAIN_DOCS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model from `labelled(doc_id, text, lang)`."""
    sample = sampled(labelled, most_docs)
    spoken = durable(sample.repartition(32).mapInArrow(_count_words, "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
    cut = spoken.mapInArrow(_count_grams, "lang string, kind int, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = spoken.select("lang", F.lit(0).alias("kind"), "key", "n").union(durable(cut, "grams"))
    totals = {(r.lang, r.kind): r.n for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    most = F.when(F.col("kind") == 0, words // max(1, len(languages))).otherwise(grams // max(1, len(languages)))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= most).select("kind", "key").distinct()
    found = counts.join(top, ["kind", "key"]).collect()  # bounded by the parameters, a row per language that has the key
    by: list[dict[str, dict[str, int]]] = [{} for _ in range(LONGEST + 1)]
    for row in sorted(found, key=lambda r: (r.kind, r.key)):
        by[row.kind].setdefault(row.key, {})[row.lang] = row.n
    tables: list[dict[str, np.ndarray]] = []
    for kind, keys in enumerate(by):
        sizes = [totals.get((lang, kind), 0) + len(keys) + 1 for lang in languages]
        tables.append({key: np.array([math.log((own.get(lang, 0) + 0.5) / n) for lang, n in zip(languages, sizes, strict=True)]) for key, own in keys.items()})
    return Model(languages, tables[0], tables[1:])


def predict(model: Model, texts: list) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lists = words_of(texts)
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    filled = (pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[at]
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = np.diff(np.concatenate([[0], np.cumsum(filled)])[ends], prepend=0)
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    total = _sums(model.rows(coded.dictionary), at, ends)
    best = total.argmax(1)
    top = total[np.arange(len(total)), best]
    share = 1 / np.exp((total - top[:, None]) / np.sqrt(np.maximum(words, 1))[:, None]).sum(1)
    return [model.languages[k] if n else UNDETERMINED for k, n in zip(best, words, strict=True)], np.where(words > 0, share, 0.0).tolist()


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with lang_pred and score, from `text` alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS
    return arrow.appended(docs, keep, "lang_pred string, score double", lambda: lambda texts: predict(held.value, texts))


def recognised(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of `docs` whose language is told with a score of `least` or more; texts without letters go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return arrow.kept(docs, lambda: lambda texts: [lang != UNDETERMINED and score >= least for lang, score in zip(*predict(held.value, texts), strict=True)])


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a fifth of them is held out from training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])


def crc32(doc_id: int | None) -> int:
    """The same number outside Spark."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


QUERIES = {"op7_word_backoff": op7_word_backoff}
ORACLES: dict[str, str] = {}
