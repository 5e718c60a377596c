"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

The patterns give the base spans. The battery judges every run of at least `SHORTEST` characters of
the usual secret alphabets, plain words and numbers too. Its encoding is inferred (the smallest
alphabet that holds it) and three tests ask whether it could be drawn evenly from that alphabet:
chi-squared on the characters' counts, the number of runs above and below the alphabet's middle, and
the serial correlation of neighbouring positions. Their p values are combined by Fisher's method into
`evenness`.

How often ordinary text looks as even as that depends on its encoding and length, so it is counted.
The characters of every text, whole but for the candidates themselves, are cut into windows of each
length class (what is left at a text's end goes on in the next text of the task), and the battery judges each window in the encoding
inferred for it, as it does with candidates. Windows in which ordinary text rarely falls by itself
come from its letters in upper case (base32), its characters from 0-9a-f (hex) and its digits alone.
Their histograms are the null distributions: one per encoding and length class. The upper-case
alphabets share the lower-case ones'. Where fewer than `ENOUGH` windows are there, those of the next
narrower encoding are added, and where there is none at all, the next shorter class's.

A candidate's p value is the share of windows of its encoding and class that are at least as even.
Benjamini-Hochberg within each length class, over all candidates of the corpus, keeps the expected
share of ordinary text among the added spans at or below `RATE`; the many short words thus do not
weigh on the long tokens. Of fewer than `SHORTEST` characters an evenly drawn token is as even as a
tenth of ordinary text, so no test can tell. Only histograms (encodings by classes by bins) leave the tasks.

Edge cases: a null text counts as empty. Runs that overlap a base span are not judged. Repeated
rows are scanned each. Ids and other kept columns of any type pass through untouched. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import arrow
from lumengraph.runtime import table

SHORTEST, RATE = 16, 0.01
#: Length classes by their shortest length, and bins of -log10(evenness), ten to a decade.
CLASSES = (16, 24, 40, 80)
BINS = 160
#: Characters that are judged at a time.
_HELD = 1 << 18
KINDS = ("assign", "access", "hex", "random")
#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
#: Alphabets by size; of those that hold a run the first one is its encoding.
_ALPHABETS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
_DIGITS, _HEX, _HEX_UP, _BASE32, _LOW, _UP = range(6)
#: Encodings that share another one's windows, and those that take in a narrower one's where they have too few.
_SHARED, _NARROWER, ENOUGH = {_HEX_UP: _HEX, _UP: _LOW}, {_BASE32: _LOW, 6: _LOW, 7: 6, 8: 6, 9: 6}, 10_000
_HOLDS, _CODES, _CENTRED = np.zeros(256, np.int16), np.zeros((len(_ALPHABETS), 256), np.int32), np.zeros((len(_ALPHABETS), 256), np.float32)
for _k, _letters in enumerate(_ALPHABETS):
    _own = np.frombuffer(_letters.encode(), np.uint8)
    _HOLDS[_own] |= 1 << _k
    _CODES[_k, _own] = np.arange(len(_own))
    _CENTRED[_k, _own] = np.arange(len(_own)) - (len(_own) - 1) / 2
#: The encoding that a set of alphabets (bits) stands for.
_FIRST = np.array([(x & -x).bit_length() - 1 for x in range(1 << len(_ALPHABETS))])
_ALL = bytes(range(256))
#: Sources of windows: what to delete of the text's ASCII, in which case, and the encoding (None: inferred).
_SOURCES = (
    (_ALL.translate(None, _ALPHABETS[-1].encode()), bytes, None),
    (_ALL.translate(None, _ALPHABETS[_BASE32][:26].encode()), bytes.upper, _BASE32),
    (_ALL.translate(None, _ALPHABETS[_HEX].encode()), bytes.lower, _HEX),
    (_ALL.translate(None, _ALPHABETS[_DIGITS].encode()), bytes, _DIGITS),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def evenness(rows: np.ndarray, encoding: int) -> np.ndarray:
    """Fisher-combined p value of each row of ASCII characters in the alphabet `encoding`."""
    (many, n), size = rows.shape, len(_ALPHABETS[encoding])
    index = _CODES[encoding][rows]
    index += np.arange(0, many * size, size, dtype=np.int32)[:, None]
    counts = np.bincount(index.ravel(), minlength=many * size).reshape(many, size)
    chi = (np.einsum("ij,ij->i", counts, counts) * (size / n) - n).astype(np.float32)
    freedom = size - 1
    # Wilson-Hilferty, with the variance that the statistic has at this length.
    z_chi = ((np.maximum(chi, 1e-9) / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom) * (1 - 1 / n))
    centred = _CENTRED[encoding][rows]
    above = centred > 0
    high = above.sum(1, dtype=np.int32).astype(np.float32)
    low = n - high
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(1, dtype=np.int32).astype(np.float32)
    expected = 1 + 2 * high * low / n
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / max(n - 1, 1), 0.25))
    z_runs = (runs - expected) / spread
    z_serial = np.einsum("ij,ij->i", centred[:, 1:], centred[:, :-1]) / np.float32((size**2 - 1) / 12 * math.sqrt(n - 1))
    p = np.stack([_upper(z_chi), 2 * _upper(np.abs(z_runs)), 2 * _upper(np.abs(z_serial))])
    half = -np.log(np.clip(p, 1e-30, 1)).sum(0)
    return np.exp(-half) * (1 + half + half * half / 2)


def _upper(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal, by a rational approximation (error below 1.5e-7 of the density's scale)."""
    a = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a)
    return np.where(z >= 0, tail, 1 - tail)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.minimum((-np.log10(np.maximum(p, 1e-30)) * 10).astype(np.int64), BINS - 1)


def judged(rows: np.ndarray, encoding: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Encoding and bin of each row of ASCII characters; all rows have one length."""
    own = _FIRST[np.bitwise_and.reduce(_HOLDS[rows], axis=1)] if encoding is None else np.full(len(rows), encoding)
    bins = np.zeros(len(rows), np.int64)
    for e in np.unique(own):
        at = np.flatnonzero(own == e)
        step = max(1, _HELD // rows.shape[1])
        for k in range(0, len(at), step):
            some = at[k : k + step]
            bins[some] = _bin(evenness(rows[some], e))
    return own, bins


def candidates(texts: list, base: list[list]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Runs that the battery judges as (text, start, end), those that overlap no base span, and per run its encoding, length class and bin."""
    runs, tokens = [], []
    for k, text in enumerate(texts):
        if text:
            for m in _RUN.finditer(text):
                start, end = m.span()
                if not any(s < end and start < e for s, _, e in base[k]):
                    runs.append((k, start, end))
                    tokens.append(m.group().rstrip("="))
    number: dict[str, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    distinct, told = list(number), np.zeros((len(number), 3), np.int64)
    told[:, 1] = np.searchsorted(CLASSES, sizes, "right") - 1
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer("".join(distinct[k] for k in at).encode(), np.uint8).reshape(len(at), n)
        told[at, 0], told[at, 2] = judged(rows)
    return runs, told[which]


def _windows(waiting: np.ndarray, encoding: int | None, counts: np.ndarray, last: bool) -> np.ndarray:
    """Adds the windows of every class over the characters to `counts`, and returns those that wait for more."""
    stretch = math.lcm(*CLASSES)
    whole = len(waiting) if last else len(waiting) // stretch * stretch
    for k, size in enumerate(CLASSES):
        rows = whole // size
        if rows:
            own, bins = judged(waiting[: rows * size].reshape(rows, size), encoding)
            counts[:, k] += np.bincount(own * BINS + bins, minlength=counts.shape[0] * BINS).reshape(-1, BINS)
    return waiting[whole:]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, encoding, class, bin, n) of rows (text): what 0 for windows of ordinary text, 1 for candidates."""
    counts = np.zeros((2, len(_ALPHABETS), len(CLASSES), BINS), np.int64)
    waiting = [np.zeros(0, np.uint8) for _ in _SOURCES]
    for part in arrow.slices(batches, 0):
        texts = part.column(0).to_pylist()
        told = candidates(texts, [base_spans(t) if t else [] for t in texts])[1]
        np.add.at(counts[1], (told[:, 0], told[:, 1], told[:, 2]), 1)
        raw = _RUN.sub("", " ".join(t for t in texts if t)).encode("ascii", "ignore")
        for k, (gone, case, encoding) in enumerate(_SOURCES):
            own = np.frombuffer(case(raw).translate(None, gone), np.uint8)
            waiting[k] = _windows(np.concatenate([waiting[k], own]), encoding, counts[0], last=False)
    for k, (_, _, encoding) in enumerate(_SOURCES):
        _windows(waiting[k], encoding, counts[0], last=True)
    found = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in found), pa.array(counts[found])], names=["what", "e", "k", "b", "n"])


def p_values(windows: np.ndarray) -> np.ndarray:
    """Share of the windows (encoding, class, bin) that are at least as even as a bin, with one for the candidate itself."""
    windows = windows.copy()
    for e, other in _SHARED.items():
        windows[e] += windows[other]
    for e, other in _NARROWER.items():
        few = windows[e].sum(1) < ENOUGH
        windows[e, few] += windows[other, few]
    for k in range(1, len(CLASSES)):
        none = ~windows[:, k].any(1)
        windows[none, k] = windows[none, k - 1]
    # A low bin is an even run: windows at least as even are those of the same bin or a lower one.
    return (1 + np.cumsum(windows, 2)) / (1 + windows.sum(2, keepdims=True))


def discoveries(rows: list[tuple[int, int, int, int, int]], rate: float = RATE) -> set[tuple[int, int, int]]:
    """(encoding, class, bin) triples whose candidates are kept by Benjamini-Hochberg at `rate` within each class."""
    counts = np.zeros((2, len(_ALPHABETS), len(CLASSES), BINS))
    for what, e, k, b, n in rows:
        counts[what, e, k, b] += n
    p, kept = p_values(counts[0]), set()
    for k in range(len(CLASSES)):
        e, b = np.nonzero(counts[1][:, k])
        order = np.argsort(p[e, k, b], kind="stable")
        seen = np.cumsum(counts[1][e, k, b][order])
        good = np.flatnonzero(p[e, k, b][order] <= rate * seen / max(seen[-1] if len(seen) else 0, 1))
        kept |= {(int(e[i]), k, int(b[i])) for i in order[: good[-1] + 1 if len(good) else 0]}
    return kept


def learn(docs: DataFrame, rate: float = RATE) -> set[tuple[int, int, int]]:
    """The kept (encoding, class, bin) triples over all texts of `docs`."""
    found = docs.select("text").mapInArrow(_histograms, "what int, e int, k int, b int, n bigint")
    rows = found.groupBy("what", "e", "k", "b").agg(F.sum("n").alias("n"))
    return discoveries([tuple(r) for r in rows.collect()], rate)  # 2 x encodings x classes x bins rows at most


def spans(texts: list, kept: set[tuple[int, int, int]]) -> list[tuple[list, list]]:
    """Per text its base spans, and all spans, as (start, kind, end)."""
    base = [base_spans(t) if t else [] for t in texts]
    found = [list(own) for own in base]
    if kept:
        runs, told = candidates(texts, base)
        for (k, start, end), cell in zip(runs, map(tuple, told.tolist()), strict=True):
            if cell in kept:
                found[k].append((start, 3, end))
    return [(own, sorted(every)) for own, every in zip(base, found, strict=True)]


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of `docs(doc_id, text)`: counts by kind, a digest of the base spans, and all spans."""
    kept = learn(docs, rate)

    def tell(texts: list) -> list[list]:
        found = spans(texts, kept)
        counts = [[sum(kind == k for _, kind, _ in every) for _, every in found] for k in range(len(KINDS))]
        return [*counts[:3], [hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], [_told(every) for _, every in found], counts[3]]

    return arrow.appended(docs, ["doc_id"], "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint", lambda: tell)


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """`docs` with every span of `text` replaced by `mark` and n_chars counted anew; no row goes."""
    kept = learn(docs, rate)

    def clean(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
        if not found:
            return text
        out, at = [], 0
        for start, _, end in found:
            if end > at:
                out += [text[at : max(start, at)], mark] if start >= at else []
                at = end
        return "".join([*out, text[at:]])

    def work(texts: list) -> list:
        return [clean(t, every) for t, (_, every) in zip(texts, spans(texts, kept), strict=True)]

    return arrow.replaced(docs, lambda: work).withColumn("n_chars", F.length("text").cast("bigint"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_randomness_battery": op2_randomness_battery}
ORACLES: dict[str, str] = {}
