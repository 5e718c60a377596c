"""Fill-in-the-middle transformation over run-length encoded character classes.

A text is a row of maximal runs of white space and of other characters. For every run is kept where
it ends and how many units there are up to its end: a token ends with each run that is no white
space, and what white space is left at a text's end is a token of its own. Where a cut after k units
falls is found by binary search of the run that reaches k units, and by arithmetic inside it. The
runs of a whole batch of texts are one array over the UTF-8 bytes (white space is ASCII, so byte runs
are character runs), and one search finds all cuts. With `unit="char"` the classes are the first and
the later bytes of characters, a run of n first bytes holds n units, and a cut may fall inside a run.

Two of a row's four draws set the cuts, the others its form. Draws are the first four numbers of the
SHA-256 of seed and id, so that a rerun, on any machine, cuts alike; rows with the same id and text
come out alike.

Edge cases: a null text is empty; an empty text, or one that holds a mark, stays plain and has null
lengths. A null id draws as an empty one. Texts go whole, whatever their length; the runs take up to
24 bytes a byte of text where classes alternate, for one batch at a time or one longer text. Other
columns are not carried but for those asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumengraph.llm.arrow import slices
from lumengraph.runtime import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and percent of those with the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Bytes of text that are encoded at a time.
BYTES = 2 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


class Runs:
    """Maximal runs of one class in texts that lie one after the other; no run goes over the end of a text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str) -> None:
        """data: UTF-8 bytes; bounds: where texts begin, and the end of the last."""
        first = (data & 0xC0) != 0x80
        kind = _SPACE[data] if unit == "token" else first
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[bounds] = True
        edges = np.flatnonzero(edge)
        self.starts, self.ends = edges[:-1], edges[1:]
        own = kind[self.starts]
        if unit == "token":
            # White space adds no unit of its own, but at the end of a text.
            last = np.searchsorted(self.ends, bounds[1:])
            last = last[last < len(own)]
            self.units = (~own).astype(np.int64)
            self.units[last[np.isin(self.ends[last], bounds)]] = 1
        else:
            self.units = np.where(own, self.ends - self.starts, 0)
        self.cumulative = np.cumsum(self.units)
        self.before = np.concatenate([[0], self.cumulative])[np.searchsorted(self.starts, bounds)]
        self.bounds, self.unit = bounds, unit
        self.chars = np.concatenate([[0], np.cumsum(first)])

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def cuts(self, after: np.ndarray) -> np.ndarray:
        """Bytes before the cut after so many units of each text; 0 units is the text's beginning."""
        wanted = self.before[:-1] + after
        run = np.searchsorted(self.cumulative, wanted, "left")
        run = np.minimum(run, max(0, len(self.starts) - 1))
        if not len(self.starts):
            return np.zeros(len(after), np.int64)
        inside = wanted - (self.cumulative[run] - self.units[run])
        at = self.ends[run] if self.unit == "token" else self._whole(self.starts[run] + inside)
        return np.where(after == 0, self.bounds[:-1], at)

    def _whole(self, at: np.ndarray) -> np.ndarray:
        """The next place that begins a character, at or after `at`."""
        firsts = np.flatnonzero(np.diff(self.chars, append=self.chars[-1] + 1))
        return firsts[np.searchsorted(firsts, at)]


def _rendered(batches: Iterator[pa.RecordBatch], keep: int, names: list[str], unit: str, rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    """`keep` columns, then the text and its four draws, to the kept columns and those of the operator."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for part in slices(batches, keep, size=BYTES):
        texts = pc.fill_null(part.column(keep).cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        runs = Runs(data, bounds - bounds[0], unit)
        n = runs.counts()
        one, two, cut, side = (part.column(keep + 1 + k).to_numpy() for k in range(4))
        low, high = runs.cuts(np.minimum(one % (n + 1), two % (n + 1))), runs.cuts(np.maximum(one % (n + 1), two % (n + 1)))
        start, end = runs.bounds[:-1], runs.bounds[1:]
        held = pa.array(np.zeros(len(n), bool))
        for mark in marks:
            held = pc.or_(held, pc.match_substring(texts, mark))
        plain = (n == 0) | held.to_numpy(zero_copy_only=False) | (cut % 100 >= rate)
        first = side % 100 < suffix_first
        out, form = [], []
        for a, b, c, d, whole, spm in zip(start, low, high, end, plain, first, strict=True):
            pieces = data[a:b].tobytes(), data[b:c].tobytes(), data[c:d].tobytes()
            form.append(PLAIN if whole else SPM if spm else PSM)
            out.append(b"".join(pieces) if whole else b"".join((s, pieces[2], p, pieces[0], m, pieces[1])) if spm else b"".join((p, pieces[0], s, pieces[2], m, pieces[1])))
        prefix, middle = runs.chars[low] - runs.chars[start], runs.chars[high] - runs.chars[low]
        made = [pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*part.columns[:keep], *made], names=names)


def fill_in_middle(docs: DataFrame, keep: list[str], unit: str = "token", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`keep` columns of `docs` with n units, form, prefix_chars, middle_chars and output.

    unit: "token" (white space and what follows it) or "char".
    """
    if unit not in ("token", "char"):
        raise ValueError(f"no unit {unit!r}")
    made = StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    schema = StructType([*(docs.schema[c] for c in keep), *made.fields])
    rows = docs.select(*keep, F.col(text).alias("\x1ftext"), *(x.alias(f"\x1f{k}") for k, x in enumerate(draws(F.col(key), seed))))
    return rows.mapInArrow(lambda batches: _rendered(batches, len(keep), schema.names, unit, rate, suffix_first), schema)


def restored(form: Column, output: Column) -> Column:
    """The text before the transformation: between marks, which no text that was cut holds itself."""
    one, two = F.when(form == SPM, F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.lit(MIDDLE)
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    at, end = F.position(one, body), F.position(two, body)
    left = F.substring(body, F.lit(1), at - 1)
    right = F.substring(body, at + len(PREFIX), end - at - len(PREFIX))
    middle = F.substring(body, end + len(MIDDLE), F.lit(2**31 - 1))
    return F.when(form == PLAIN, output).when(form == SPM, F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut or left plain, by digests of its output and of the text rebuilt from that."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
h AS (SELECT doc_id, text, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLES = {"op11_fill_middle": _SQL}
