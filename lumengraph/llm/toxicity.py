"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings of four and five characters
(so that inflected forms share a term), hashed to `SLOTS` slots. The machine adds a weight per slot
and, for every pair of slots, the product of their factors: an insult beside a mention of a group
can weigh more than both alone, also where neither term tells anything alone. The machine holds the
slots that the training rows tie to a label by themselves (chi-squared of `LEAST` or more) and those
of pairs that are tied to it more than either term is, beyond what chance gives among all pairs; pairs
are counted among the `PAIRED` slots that most training rows hold. Weights and factors are fitted by AdaGrad on the logistic loss.

It is fitted on at most about `TRAIN_ROWS` labelled ids, those that hash below a bound that follows
from their number; slot statistics, weights and factors come from these rows. Slots are counted in
the cluster; only the held ones and the `PAIRED` most frequent ones of each row come to the driver.

Edge cases: a null text counts as empty and gets the score of the bias alone. Rows without a label
of 0 or 1 are not learned from; an id with both labels is learned as 1; with no labels, or one label
only, every score is the share of ones (0 with no rows). Repeated rows are scored each and learned
from once. Ids and other kept columns of any type pass through untouched. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import arrow
from lumengraph.llm.language_id import remainder
from lumengraph.runtime import durable, table

#: Documented bounds of the training sample and of the model.
TRAIN_ROWS, SLOTS, MOST_SLOTS, FACTORS = 20_000, 1 << 20, 30_000, 4
LEAST = 6.6
#: Slots whose pairs are counted, and the rows that are counted at a time.
PAIRED, _DENSE = 2048, 2048
EPOCHS, BATCH, STEP, SHRINK = 15, 128, 0.1, 1e-5
THRESHOLD = 0.7
_BETWEEN = r"[^\p{L}\p{N}_]+"


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) % SLOTS


def slots(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, slot) of each distinct word and of its beginnings; the empty word has none."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes > 0)
    place, found = [whole], [np.fromiter(map(slot, words.take(pa.array(whole)).to_pylist()), np.int64, len(whole))]
    for k in (4, 5):
        longer = np.flatnonzero(sizes > k)
        cut = pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, k).dictionary_encode()
        own = np.fromiter((slot(f"{p}*") for p in cut.dictionary.to_pylist()), np.int64, len(cut.dictionary))
        place.append(longer)
        found.append(own[cut.indices.to_numpy(zero_copy_only=False)])
    return np.concatenate(place), np.concatenate(found)


@dataclass
class Machine:
    bias: float
    column: dict[int, int]  # slot to row of weights and factors
    weights: np.ndarray
    factors: np.ndarray

    @cached_property
    def columns(self) -> np.ndarray:
        """Row of weights of every slot, -1 for those not held."""
        at = np.full(SLOTS, -1, np.int64)
        at[list(self.column)] = list(self.column.values())
        return at

    def score(self, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of texts that hold these rows of weights, each text's in a row."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        x = self.bias + np.bincount(doc, self.weights[columns], len(sizes))
        for factor in self.factors.T:
            v = factor[columns]
            x += 0.5 * (np.bincount(doc, v, len(sizes)) ** 2 - np.bincount(doc, v * v, len(sizes)))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct slots of each text, one text after the other, and how many it has.

    known: what stands for each slot instead, slots of -1 being left out.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _BETWEEN)
    coded = lists.flatten().dictionary_encode()
    place, own = slots(coded.dictionary)
    if known is not None:
        own = known[own]
        place, own = place[own >= 0], own[own >= 0]
    order = np.argsort(place, kind="stable")
    own, sizes = own[order], np.bincount(place, minlength=len(coded.dictionary))
    firsts = np.cumsum(sizes) - sizes
    at = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = sizes[at] > 0
    doc, at = doc[some], at[some]
    # A text's distinct words first: repeats are most of a text.
    wide = np.int64(max(1, len(sizes)))
    pairs = np.unique(doc * wide + at)
    doc, at = pairs // wide, pairs % wide
    runs = sizes[at]
    ends = np.cumsum(runs)
    slot_of = own[np.repeat(firsts[at] - (ends - runs), runs) + np.arange(int(runs.sum()))]
    both = np.unique(np.repeat(doc, runs) * np.int64(SLOTS) + slot_of)
    return both % SLOTS, np.bincount(both // SLOTS, minlength=len(lists))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, slots) of rows (label, text)."""
    for part in arrow.slices(batches, 1):
        own, sizes = held(part.column(1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found = [own[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["label", "slots"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n, ones) of rows (label, slots), summed per task."""
    counts = np.zeros((2, SLOTS), np.int64)
    for part in batches:
        for label, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            at = np.frombuffer(own, "<i4")
            counts[0, at] += 1
            counts[1, at] += label
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["slot", "n", "ones"])


def _chi(df: np.ndarray, ones: np.ndarray, rows: int, share: float) -> np.ndarray:
    """Chi-squared of slots against the label; 0 for those that fewer than 3 rows hold."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(df >= 3, (ones - df * share) ** 2 / (df * share * (1 - share) * (1 - df / (rows + 1))), 0)


def _paired(flat: np.ndarray, doc: np.ndarray, y: np.ndarray, df: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Slots of pairs whose chi-squared exceeds that of either slot by more than chance gives."""
    common = np.argsort(-df, kind="stable")[:PAIRED]
    common = common[df[common] >= 3]
    at = np.full(SLOTS, -1, np.int32)
    at[common] = np.arange(len(common), dtype=np.int32)
    keep = at[flat] >= 0
    cols, doc = at[flat[keep]], doc[keep]
    both, ones = np.zeros((2, len(common), len(common)), np.float32)  # whole numbers, exact
    for first in range(0, len(y), _DENSE):
        a, b = np.searchsorted(doc, (first, first + _DENSE))
        held = np.zeros((min(_DENSE, len(y) - first), len(common)), np.float32)
        held[doc[a:b] - first, cols[a:b]] = 1
        toxic = held[y[first : first + _DENSE] == 1]
        both += held.T @ held
        ones += toxic.T @ toxic
    share, limit = y.mean(), LEAST + 2 * np.log(max(len(common), 2) ** 2 / 2)
    found = np.zeros(len(common), bool)
    for k, slot in enumerate(common):
        n = both[k].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(n >= 3, (ones[k] - n * share) ** 2 / (n * share * (1 - share) * (1 - n / (len(y) + 1))), 0)
        telling = own - np.maximum(chi[slot], chi[common]) >= limit
        telling[k] = False
        found |= telling
        found[k] |= telling.any()
    return common[found]


def fit(rows: list[tuple[int, np.ndarray]], seed: int = 11) -> Machine:
    """A machine from (label, slots) rows."""
    y = np.array([r[0] for r in rows], float)
    share = float(y.mean()) if len(y) else 0.0
    none = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), {}, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or share in (0.0, 1.0):
        return none
    sizes = np.array([len(r[1]) for r in rows])
    flat = np.concatenate([np.asarray(r[1], np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    df = np.bincount(flat, minlength=SLOTS)
    ones = np.bincount(flat, weights=y[doc], minlength=SLOTS)
    chi = _chi(df, ones, len(y), share)
    best = np.argsort(-chi, kind="stable")[:MOST_SLOTS]
    best = best[chi[best] >= LEAST]
    # A term that tells nothing alone may tell beside another.
    pairs = np.setdiff1d(_paired(flat, doc, y, df, chi), best)
    best = np.concatenate([best[: MOST_SLOTS - len(pairs)], pairs])
    if not len(best):
        return none
    at = np.full(SLOTS, -1, np.int32)
    at[best] = np.arange(len(best), dtype=np.int32)
    keep = at[flat] >= 0
    cols, doc = at[flat[keep]], doc[keep]
    starts = np.searchsorted(doc, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(best)), rng.normal(0, 0.01, (len(best), FACTORS)), np.log(share / (1 - share))
    gw, gv, gb = np.full(len(best), 1e-3), np.full((len(best), FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            pick = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in own]) if len(own) else np.zeros(0, int)
            row = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            c = cols[pick]
            vc = v[c]
            total = np.stack([np.bincount(row, vc[:, f], len(own)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vc * vc).sum(1), len(own))
            x = b + np.bincount(row, w[c], len(own)) + 0.5 * ((total * total).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y[own]
            used, back = np.unique(c, return_inverse=True)
            grad = np.bincount(back, error[row], len(used)) / len(own) + SHRINK * w[used]
            pair = error[row][:, None] * (total[row] - vc)
            grad_v = np.stack([np.bincount(back, pair[:, f], len(used)) for f in range(FACTORS)], 1) / len(own) + SHRINK * v[used]
            gw[used] += grad**2
            gv[used] += grad_v**2
            gb += error.mean() ** 2
            w[used] -= STEP * grad / np.sqrt(gw[used])
            v[used] -= STEP * 0.3 * grad_v / np.sqrt(gv[used])
            b -= STEP * error.mean() / np.sqrt(gb)
    return Machine(float(b), {int(s): k for k, s in enumerate(best)}, w, v)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Machine:
    """From `docs(doc_id, text)` and `labels(doc_id, label)`."""
    usable = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    share = most_rows / max(usable.count(), most_rows)
    sample = durable(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))), "sample")
    # About `most_rows` rows of two numbers by the line above; counted all the same before they are sent to every task.
    small = F.broadcast(sample) if sample.count() <= 2 * most_rows else sample
    joined = docs.select("doc_id", "text").join(small, "doc_id").dropDuplicates(["doc_id", "text"])
    rows = durable(joined.select("label", "text").mapInArrow(_features, "label int, slots binary"), "features")
    told = rows.mapInArrow(_slot_counts, "slot int, n bigint, ones bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()  # at most SLOTS rows
    df, ones = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    at = told["slot"].to_numpy()
    df[at], ones[at] = told["n"].to_numpy(), told["ones"].to_numpy()
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    chi = _chi(df, ones, sums.n, sums.ones / max(sums.n, 1)) if 0 < sums.ones < sums.n else np.zeros(SLOTS)
    telling, common = np.argsort(-chi, kind="stable")[:MOST_SLOTS], np.argsort(-df, kind="stable")[:PAIRED]
    wanted = np.zeros(SLOTS, bool)
    wanted[telling[chi[telling] >= LEAST]] = True
    wanted[common[df[common] >= 3]] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # SLOTS bits

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = np.unpackbits(bits.value).astype(bool)
        for part in batches:
            own = [x[good[x]].tobytes() for x in (np.frombuffer(o, "<i4") for o in part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["label", "slots"])

    found = rows.mapInArrow(reduced, "label int, slots binary").toArrow()  # at most MOST_SLOTS + PAIRED numbers of each of about `most_rows` rows
    listed = sorted(zip(found["label"].to_pylist(), found["slots"].to_pylist(), strict=True))
    return fit([(label, np.frombuffer(own, "<i4")) for label, own in listed])


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with `score`, from `text` alone."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # at most MOST_SLOTS rows
    return arrow.appended(docs, keep, "score double", lambda: lambda texts: [sent.value.score(*held(pa.array(texts, pa.string()), sent.value.columns))])


def op9_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of them is held out from training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    machine = train(docs.where(~F.col("held_out")), labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score(docs, machine, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op9_factorization_machine": op9_factorization_machine}
ORACLES: dict[str, str] = {}
