"""Best-fit packing by a configuration linear program over the length histogram.

A document's ids are cut into pieces of at most `capacity`; only documents longer than that are
cut. Full pieces fill a sequence each. For the rest only the histogram of lengths matters: at most
`capacity` numbers, whatever the corpus size. The configuration program (a variable per multiset of
lengths that fits, as few sequences as possible, every length covered) is solved on it in fractions
by multiplicative weights: each round solves one knapsack dynamic program for the most valuable
filling of every room at the lengths' weights, uses for each length the configuration that holds it,
whatever room that leaves, if it comes within `NEAR` of the best value, and raises the weights of
the lengths that stay short of the round's share. A share of the fractional uses is rounded down and
the lengths left over go in by best fit, longest first, into the fullest sequence with room; of
`SHARES` the one counts that ends with the fewest sequences (where few pieces have a length, all but
small uses round to nothing, and a small share leaves best fit the short pieces that it needs; share
0 is best fit alone, so no plan is worse than that).

The plan is a list of sequence groups with equal contents. Pieces of a length are numbered without
gathering them (counts per salt, then ranks inside a salt; the more pieces, the more salts), and a
piece's number gives its place.

Edge cases: a null text is empty and yields its end id alone. Repeated rows are packed each. Ids of
any type pass through untouched, null ones too. Extra columns are ignored. Ids that repeat are told
apart by nothing but their place. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumengraph.llm.arrow import slices
from lumengraph.runtime import durable, table

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces of one length are numbered in parts of about this many.
SALT_ROWS = 20_000
#: Rounds of multiplicative weights, the share of every length that a round adds, the most by which a
#: round raises a weight (its logarithm), how near to the best value a configuration must come, and the
#: share of a length below which it counts as covered.
ROUNDS, STEP, RATE, NEAR, LEAST = 80, 0.05, 0.01, 0.004, 1e-3
SHARES = (1.0, 0.95, 0.9, 0.8, 0.6, 0.4, 0.2, 0.0)
#: Chunks and words that a worker remembers; what is rarer is encoded again.
_CACHED_CHUNKS, _CACHED_WORDS = 300_000, 200_000
#: Texts whose chunks are counted at a time, their bytes, and texts whose ids are gathered at a time.
_BATCH, _BYTES, _GATHER = 4096, 4 << 20, 512
#: A text that holds any of these goes to the tokenizer whole: characters from U+0250 on and the listed ones (their
#: normal form or case depends on their neighbours, or the classes of `re` are not those of the tokenizer's rule), and
#: the mark of a special token.
_ODD = r"[^\x00-\x{24F}]|<\||[\x1c-\x1f\x{b2}\x{b3}\x{b9}\x{bc}\x{bd}\x{be}\x{130}]"
#: The tokenizer's own rule for words, its alternatives in an order that is quick to try.
_WORDS = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")


class _Known:
    """Ids of strings, the first `most` that come, in Arrow memory: no Python object per string."""

    def __init__(self, most: int) -> None:
        self.most, self.strings = most, pa.array([], pa.large_string())
        self.flat, self.firsts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, strings: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
        """Per distinct string where its ids are (flat ids, first, size); `learn` gives the same for new ones."""
        at = pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        flat, firsts, sizes = learn(strings.take(pa.array(new)))
        before = len(self.flat)
        own_firsts, own_sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(self.strings):
            own_firsts, own_sizes = self.firsts[at], self.sizes[at]
        own_firsts[new], own_sizes[new] = firsts + before, sizes
        flat = np.concatenate([self.flat, flat])
        room = min(len(new), self.most - len(self.strings))  # the first ones seen are the frequent ones
        if room > 0:
            self.strings = pa.concat_arrays([self.strings, strings.take(pa.array(new[:room]))])
            self.firsts, self.sizes = np.concatenate([self.firsts, own_firsts[new[:room]]]), np.concatenate([self.sizes, own_sizes[new[:room]]])
            self.flat = flat[: int((self.firsts + self.sizes).max(initial=0))]
        return flat, own_firsts, own_sizes


def _runs(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Token ids of whole texts, remembered by chunk between spaces and by word.

    The tokenizer lower-cases, drops white space, cuts what is between into words and encodes each
    by itself, so a text's ids are its words' ids in a row. Texts with characters whose normal form
    or case depends on their neighbours, or with the mark of a special token, go to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.path = path
        # The same model for words that are cut and lower-cased already.
        self.cut_words = Tokenizer.from_file(path)
        self.cut_words.normalizer = None
        self.cut_words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks, self.words = _Known(_CACHED_CHUNKS), _Known(_CACHED_WORDS)
        vocabulary = self.cut_words.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        """The tokenizer itself, for texts that go to it whole."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048].to_pylist()
            ids = np.array(self.cut_words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                own = np.diff(ends, prepend=0)
            else:
                each = [self._ids(w) for w in some]
                ids, own = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            found.append(ids)
            sizes.append(own)
        sizes = np.concatenate(sizes)
        return np.concatenate(found), np.cumsum(sizes) - sizes, sizes

    def _learn_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A chunk of letters alone is a word; others are cut by the rule."""
        letters = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        one, more = np.flatnonzero(letters), np.flatnonzero(~letters)
        cut = list(map(_WORDS.findall, chunks.take(pa.array(more)).to_pylist()))
        several = pa.array([w for words in cut for w in words], pa.large_string())
        coded = pa.concat_arrays([chunks.take(pa.array(one)), several]).dictionary_encode()
        flat, firsts, sizes = self.words.ids(coded.dictionary, self._learn_words)
        at = coded.indices.to_numpy(zero_copy_only=False)
        runs = sizes[at]
        each = np.concatenate([np.ones(len(one), np.int64), np.fromiter(map(len, cut), np.int64, len(cut))])  # words of a chunk
        ends = np.concatenate([[0], np.cumsum(runs)])[np.cumsum(each)]
        own_sizes, own_firsts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        order = np.concatenate([one, more])
        own_sizes[order] = np.diff(ends, prepend=0)
        own_firsts[order] = ends - own_sizes[order]
        return flat[_runs(firsts[at], runs)], own_firsts, own_sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; null counts as empty.

        Splitting, counting and looking up of chunks run in Arrow's kernels; Python sees what is
        new, and the texts' ids are gathered from the chunks' ids by number.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        coded = lists.values.dictionary_encode()
        bounds = lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()
        at = coded.indices.to_numpy(zero_copy_only=False)
        known = self._gathered(*self.chunks.ids(coded.dictionary, self._learn_chunks), at, bounds)
        whole = map(self._ids, texts.filter(odd).to_pylist())
        return [next(whole) if o else next(known) for o in odd.to_pylist()]

    def _gathered(self, flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Each text's ids from its chunks' numbers, some texts at a time to bound the index arrays."""
        for k in range(0, len(bounds) - 1, _GATHER):
            last = min(k + _GATHER, len(bounds) - 1)
            own = at[bounds[k] : bounds[last]]
            ids = flat[_runs(firsts[own], sizes[own])]
            cuts = np.concatenate([[0], np.cumsum(sizes[own])])[bounds[k : last + 1] - bounds[k]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield ids[a:b]


_encoders: dict[str, Encoder] = {}


def _pieces(path: str | None, capacity: int):
    """Pieces of each batch: the id as it came, then piece, start, length, ids_crc32 and a running number of the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        place = path or public_tokenizers.path(TOKENIZER)
        if place not in _encoders:
            _encoders[place] = Encoder(place)
        encoder, end, given = _encoders[place], np.array([END], "<u4").tobytes(), 0
        for part in slices(batches, 1, _BATCH, _BYTES):
            out = []
            for row, ids in enumerate(encoder.encode(part.column(1))):
                size = len(ids) + 1
                for k, start in enumerate(range(0, size, capacity)):
                    length = min(capacity, size - start)
                    crc = zlib.crc32(ids[start : start + length])
                    out.append((row, k, start, length, zlib.crc32(end, crc) if start + length == size else crc))
            rows, *columns = np.array(out, np.int64).reshape(-1, 5).T
            numbers = [pa.array(x, t) for x, t in zip((*columns, np.arange(given, given + len(out))), (pa.int32(), *[pa.int64()] * 4), strict=True)]
            given += len(out)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32", "given"])

    return cut


def prices(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most valuable filling of every capacity and its last length (-1: one less room)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    down = lengths[::-1]  # of equal values the longest length comes first
    worth = value[down]
    for c in range(int(lengths[0]), capacity + 1):
        skip = len(lengths) - int(np.searchsorted(lengths, c, "right"))
        total = best[c - down[skip:]] + worth[skip:]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], down[skip + k]
        else:
            best[c] = best[c - 1]
    return best, choice


def configuration(length: int, choice: np.ndarray, left: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The priced configuration that holds `length`, within what is left, and the room it leaves."""
    uses, room = {length: 1}, capacity - length
    c = room
    while c > 0:
        next_one = int(choice[c])
        if next_one < 0 or left[next_one] <= uses.get(next_one, 0):
            c -= 1
            continue
        uses[next_one] = uses.get(next_one, 0) + 1
        room -= next_one
        c = min(c - next_one, room)
    return uses, room


def covering(asked: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations towards `asked`, none above it, and a lower bound on the sequences of any cover."""
    lengths, weight = np.flatnonzero(asked), np.arange(capacity + 1, dtype=float)
    uses_of: dict[tuple, float] = {}
    covered, bound = np.zeros(capacity + 1), 0.0
    for k in range(rounds):
        # A round lets every length come to the same share of its count, so that short ones last for all.
        limit = min(1.0, (k + 1) * STEP)
        free = limit * asked - covered
        free[free < LEAST * asked] = 0
        open_ones = lengths[free[lengths] > 0]
        if not len(open_ones):
            if limit == 1.0:
                break
            continue
        best, choice = prices(weight, open_ones, capacity)
        bound = max(bound, float((asked * weight)[open_ones].sum() / best[capacity]))
        for length in open_ones[::-1].tolist():
            if not free[length]:
                continue
            uses, _ = configuration(length, choice, np.where(free > 0, asked, 0), capacity)
            if sum(weight[j] * n for j, n in uses.items()) < (1 - NEAR) * best[capacity]:
                continue
            times = min(free[j] / n for j, n in uses.items())
            key = tuple(sorted(uses.items(), reverse=True))
            uses_of[key] = uses_of.get(key, 0.0) + times
            for j, n in uses.items():
                covered[j] += n * times
                free[j] -= n * times
                if free[j] < LEAST * asked[j]:
                    free[j] = 0
        weight[open_ones] *= np.exp(RATE * free[open_ones] / (limit * asked[open_ones]))
    return uses_of, bound


def rounded(left: np.ndarray, uses: dict[tuple, float], share: float, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Groups from a share of the fractional uses rounded down, the rest by best fit."""
    left, owed, groups = left.copy(), 0.0, []
    # Running sums of the uses are rounded down, in an order in which like configurations are neighbours.
    for key, times in sorted(uses.items(), reverse=True):
        owed += share * times
        whole = min(int(owed + 1e-9), *(int(left[k]) // n for k, n in key))
        owed -= int(owed + 1e-9)
        if whole:
            groups.append((whole, dict(key)))
            for k, n in key:
                left[k] -= n * whole
    return best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity, groups)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """Sequence groups (how many sequences, lengths in each) that hold every length of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    full = [(int(left[capacity]), {capacity: 1})] if left[capacity] else []
    left[capacity] = 0
    uses = covering(left.copy(), capacity, rounds)[0]
    plans = [rounded(left, uses, share, capacity) for share in SHARES]
    return full + min(plans, key=lambda groups: sum(n for n, _ in groups))


def best_fit(histogram: dict[int, int], capacity: int, groups: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, on counts, into the room of `groups` and new ones: sequences with equal contents are one group."""
    by_room: dict[int, list[list]] = {}
    for n, uses in groups:
        by_room.setdefault(capacity - sum(k * m for k, m in uses.items()), []).append([n, uses])
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for room in sorted(r for r in by_room if r >= length):
            while n and by_room.get(room):
                group = by_room[room].pop()
                each = min(room // length, n)  # as many as fit in one sequence
                take = min(group[0], n // each)
                if group[0] > take:
                    by_room[room].append([group[0] - take, group[1]])
                by_room.setdefault(room - each * length, []).append([take, group[1] | {length: group[1].get(length, 0) + each}])
                n -= take * each
            if room in by_room and not by_room[room]:
                del by_room[room]
            if not n:
                break
        each = capacity // length
        for times, count in ((n // each, each), (1, n % each)):
            if times and count:
                by_room.setdefault(capacity - count * length, []).append([times, {length: count}])
    return [(n, uses) for groups in by_room.values() for n, uses in groups]


def _placer(groups: list[tuple[int, dict[int, int]]]):
    """Places of the numbered pieces of every length: a bounded table of groups, searched by number."""
    slots: dict[int, list] = {}
    first = 0
    for n, uses in groups:
        offset = 0
        for length in sorted(uses, reverse=True):
            slots.setdefault(length, []).append((n * uses[length], uses[length], first, offset))
            offset += length * uses[length]
        first += n
    tables = {}
    for length, rows in slots.items():
        count, each, base, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        tables[length] = (np.cumsum(count), count, each, base, offset)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            number, lengths = part.column("number").to_numpy(), part.column("length").to_numpy()
            sequence, offsets = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                ends, count, each, base, offset = tables[int(length)]
                g = np.searchsorted(ends, number[at], "right")
                k = number[at] - (ends[g] - count[g])
                sequence[at] = base[g] + k // each[g]
                offsets[at] = offset[g] + k % each[g] * length
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sequence), pa.array(offsets)], names=[*part.schema.names[:-1], "sequence_id", "offset"])

    return place


def numbered(pieces: DataFrame, histogram: dict[int, int], salt_rows: int = SALT_ROWS) -> DataFrame:
    """`pieces(length, given, ...)` with `number`, from 0 within each length; a common length is spread over salts that its count asks for."""
    most = max(histogram, default=0)
    salts = F.array(*[F.lit(-(-histogram.get(k, 1) // salt_rows)) for k in range(most + 1)])
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "given"), F.element_at(salts, (F.col("length") + 1).cast("int")))
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "given")) - 1
    return salted.withColumn("rank", rank).join(starts, ["length", "salt"]).withColumn("number", F.col("before") + F.col("rank")).drop("salt", "rank", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Per piece of `docs(doc_id, text)`: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a tokenizer file; None takes the public word-level one.
    """
    columns = "piece int, start bigint, length bigint, ids_crc32 bigint"
    made = StructType([docs.schema["doc_id"], *StructType.fromDDL(f"{columns}, given bigint").fields])
    pieces = durable(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), made), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed = numbered(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL(f"{columns}, sequence_id bigint, offset bigint").fields])
    return placed.mapInArrow(_placer(plan(histogram, capacity)), out)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
