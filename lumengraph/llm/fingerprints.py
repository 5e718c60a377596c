"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

A term is a maximal run of letters and digits of the lower-cased text. The lexicon holds the terms
whose inverse document frequency ``ln(N / df)`` lies in a band. Each of `SUBSETS` randomised
lexicons keeps a term with probability ``2 ** -level``; levels run from 2 to 9 so that short and
long texts both meet subsets that leave them a few terms. A document's fingerprint is, per subset,
a hash of its distinct remaining terms in sorted order.

Edge cases: a null text counts as empty. A text with no term in the band has an empty mark in
every subset and a last field holding the hash of the whole text, so equal texts still have equal
fingerprints. Repeated rows are kept, each with its own row. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.runtime import durable, table

SUBSETS = 32
LEVELS = (2, 3, 4, 5, 6, 7, 8, 9)
#: Share of documents that hold a term, lowest and highest: the IDF band as document frequencies.
BAND = (0.002, 0.1)
#: The lexicon holds at most (mean distinct terms of a document) / BAND[0] terms whatever the
#: corpus size. It is counted; up to this many terms it is held as a constant, beyond it is joined.
HELD_TERMS = 400_000
#: Groups of neighbouring ids, each one sort group of the next-document window: one for so many rows, within these bounds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 20_000, 1024, 65_536
#: What a subset that leaves no term hashes to: the start of MD5 of the empty string.
EMPTY = "d41d8cd9"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(words), "")


def _level(k: int) -> int:
    return LEVELS[k % len(LEVELS)]


def _mask(term: Column) -> Column:
    """Bit k is set if randomised lexicon k holds the term."""
    bits = F.lit(0).cast("bigint")
    for k in range(SUBSETS):
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), term).cast("binary")), 1, 8), 16, 10).cast("bigint")
        bits = bits + F.when(draw % (1 << _level(k)) == 0, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return bits


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Terms within the band over every row of `texts(text)`, each with its subset mask."""
    total = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = math.log(1 / band[1]), math.log(1 / band[0])
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    kept = counts.where((idf >= low - 1e-12) & (idf <= high + 1e-12))
    return kept.select("term", _mask(F.col("term")).alias("mask"))


def marks(found: Column, whole: Column) -> Column:
    """The fingerprint of sorted distinct (term, mask) pairs: one mark per subset, then the fallback."""
    def mark(bit: int) -> Column:
        left = F.filter(found, lambda x: x["mask"].bitwiseAND(F.lit(bit).cast("bigint")) != 0)
        return F.substring(F.md5(F.concat_ws(" ", left["term"]).cast("binary")), 1, 8)

    parts = [mark(1 << k) for k in range(SUBSETS)]
    return F.concat(F.array(*parts), F.array(F.when(F.size(found) == 0, whole).otherwise(F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal marks among the subsets that leave either text a term.

    Where neither has any, 1 for equal fingerprints and 0 otherwise.
    """
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    filled = F.filter(F.slice(pairs, 1, SUBSETS), lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.size(F.filter(filled, lambda p: p["x"] == p["y"]))
    return F.when(F.size(filled) == 0, (a == b).cast("double")).otherwise(same / F.size(filled)).cast("double")


def _ranges(docs: DataFrame) -> list[int]:
    """Upper ends of id ranges, each an id that occurs; the last is the largest id. The more rows, the more ranges."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, docs.count() // RANGE_ROWS))
    steps = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.percentile_approx("doc_id", steps, 10 * ranges).alias("p"), F.max("doc_id").alias("m")).first()
    return sorted({*(row.p or []), row.m}) if row.m is not None else []


def _place(ends: list[int]) -> tuple[Column, Column]:
    """Number of the range an id lies in, and whether the id is its end: two short steps instead of a scan of all ends."""
    step = max(1, math.isqrt(len(ends)))
    rows = [ends[i : i + step] for i in range(0, len(ends), step)]
    tops = F.array(*[F.lit(r[-1]).cast("bigint") for r in rows])
    inner = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in r]) for r in rows])
    block = F.size(F.filter(tops, lambda e: e < F.col("doc_id")))
    own = F.element_at(inner, F.least(block + 1, F.lit(len(rows))))
    inside = F.size(F.filter(own, lambda e: e < F.col("doc_id")))
    return F.coalesce(block * step + inside, F.lit(0)), F.coalesce(F.get(own, inside) == F.col("doc_id"), F.lit(False))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, rn, extra, doc_id, text, next_text) in descending doc_id, the last followed by the first.

    Ids are cut into ranges at ids that occur, so the row that follows a range is known and is sent
    along with it (extra = true): one shuffle, no global sort, no group larger than a range.
    Ties on doc_id are ordered by text; null ids come last.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ends = _ranges(docs)
    if not ends:
        placed = docs.select(F.explode(F.array(F.struct(F.lit(0).alias("range"), F.lit(False).alias("extra")), F.struct(F.lit(0).alias("range"), F.lit(True).alias("extra")))).alias("at"), "*")
    else:
        place, is_end = _place(ends)
        at = docs.withColumn("own", place)
        last = len(ends) - 1
        own = F.struct(F.col("own").alias("range"), F.lit(False).alias("extra"))
        follow = F.when(is_end, F.struct(F.when(F.col("own") == last, F.lit(0)).otherwise(F.col("own") + 1).alias("range"), F.lit(True).alias("extra")))
        placed = at.select(F.explode(F.filter(F.array(own, follow), lambda x: x.isNotNull())).alias("at"), "doc_id", "text")
    w = Window.partitionBy("range").orderBy(F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return placed.select("at.range", "at.extra", "doc_id", "text").select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the start of the following one."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def _table_lookup(words: list, text: Column) -> Column:
    """Sorted (term, mask) pairs of a text's lexicon terms, from a hash table held as a constant.

    The table is one JSON constant that the optimizer folds into an array of buckets, so a look-up
    is an array access and a comparison or two; no row leaves its task.
    """
    buckets: list[list] = [[] for _ in range(1 << max(4, len(words).bit_length()))]
    for term, mask, bucket in words:
        buckets[bucket % len(buckets)].append({"term": term, "mask": mask})
    held = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<term: string, mask: bigint>>>")
    at = lambda t: F.element_at(held, (F.pmod(F.hash(t).cast("bigint"), F.lit(len(buckets)).cast("bigint")) + 1).cast("int"))
    return F.array_sort(F.flatten(F.transform(terms(text), lambda t: F.filter(at(t), lambda x: x["term"] == t))))


def _joined_lookup(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The same pairs for `text` and `edit` by a join with the lexicon, where it is too large to hold."""
    keys = ["range", "rn", "extra", "doc_id"]
    each = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edit").alias("body")))).alias("v"))
    each = each.select(*keys, "v.kind", F.explode(terms(F.col("v.body"))).alias("term")).join(words, "term")
    pairs = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("term", "mask"))))
    found = each.groupBy("range", "rn").agg(pairs(0).alias("f0"), pairs(1).alias("f1"))
    none = F.array().cast("array<struct<term: string, mask: bigint>>")
    return rows.join(found, ["range", "rn"], "left").withColumns({f: F.coalesce(f, none) for f in ("f0", "f1")})


def fingerprint_edits(docs: DataFrame, band: tuple[float, float] = BAND, most_held: int = HELD_TERMS) -> DataFrame:
    """Fingerprints of `docs(doc_id, text)` and of their edited texts, with likenesses."""
    words = durable(lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), band), "lexicon")
    rows = with_next(docs).withColumn("edit", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    if words.count() <= most_held:
        held = [tuple(r) for r in words.select("term", "mask", F.pmod(F.hash("term").cast("bigint"), F.lit(1 << 31)).alias("b")).collect()]
        rows = rows.withColumns({"f0": _table_lookup(held, F.col("text")), "f1": _table_lookup(held, F.col("edit"))})
    else:
        rows = _joined_lookup(rows, words)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    rows = rows.select("range", "rn", "extra", "doc_id", F.length("text").cast("bigint").alias("n_chars"), sha("text").alias("s0"), sha("edit").alias("s1"), "f0", "f1")
    rows = rows.select("range", "rn", "extra", "doc_id", "n_chars", "s1", marks(F.col("f0"), F.substring("s0", 1, 16)).alias("m0"), marks(F.col("f1"), F.substring("s1", 1, 16)).alias("m1"))
    rows = rows.withColumn("m2", F.lead("m0").over(Window.partitionBy("range").orderBy("rn"))).where(~F.col("extra"))
    return rows.select(
        "doc_id", "n_chars", F.col("s1").alias("edited_sha256"),
        F.concat_ws("-", "m0").alias("fingerprint"), F.concat_ws("-", "m1").alias("edited_fingerprint"),
        likeness(F.col("m0"), F.col("m1")).alias("near_edited"), likeness(F.col("m0"), F.col("m2")).alias("near_next"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_like(a: str, b: str) -> str:
    filled = f"list_filter(range(1, {SUBSETS + 1}), lambda i: {a}[i] <> '{EMPTY}' OR {b}[i] <> '{EMPTY}')"
    return f"CASE WHEN len({filled}) = 0 THEN CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_filter({filled}, lambda i: {a}[i] = {b}[i]))::DOUBLE / len({filled}) END"


# A term stands once for each subset that holds it (about two of them), so that all marks come from one grouping.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text DESC) AS rn FROM documents),
n AS (SELECT *, length(body) AS n_chars, coalesce(lead(body) OVER o, first_value(body) OVER o) AS nxt, coalesce(lead(rn) OVER o, 1) AS nrn FROM d WINDOW o AS (ORDER BY rn)),
e AS MATERIALIZED (SELECT rn, nrn, doc_id, n_chars, body, substr(body, 1, (n_chars - n_chars // 3)::BIGINT) || substr(nxt, 1, (n_chars // 3)::BIGINT) AS edit FROM n),
t AS MATERIALIZED (SELECT rn, 0 AS kind, sha256(body) AS sha, body FROM e UNION ALL SELECT rn, 1, sha256(edit), edit FROM e),
x AS MATERIALIZED (SELECT rn, kind, term FROM (SELECT rn, kind, unnest(list_distinct(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'))) AS term FROM t) WHERE term <> ''),
l AS MATERIALIZED (SELECT term FROM x WHERE kind = 0 GROUP BY term
      HAVING ln((SELECT greatest(count(*), 1) FROM d)::DOUBLE / count(*)) BETWEEN {math.log(1 / BAND[1]) - 1e-12!r} AND {math.log(1 / BAND[0]) + 1e-12!r}),
s AS MATERIALIZED (SELECT term, k FROM l, range({SUBSETS}) AS u(k) WHERE ('0x' || substr(md5(k || ':' || term), 1, 8))::BIGINT % (1 << {list(LEVELS)}[k % {len(LEVELS)} + 1]) = 0),
g AS (SELECT rn, kind, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS mark FROM x JOIN s USING (term) GROUP BY ALL),
h AS (SELECT rn, kind, map(list(k), list(mark)) AS marks FROM g GROUP BY ALL),
i AS (SELECT DISTINCT rn, kind FROM x JOIN l USING (term)),
m AS MATERIALIZED (
  SELECT t.rn, t.kind, sha, list_concat(list_transform(range({SUBSETS}), lambda k: coalesce(marks[k], '{EMPTY}')), [CASE WHEN i.rn IS NULL THEN substr(sha, 1, 16) ELSE '' END]) AS m
  FROM t LEFT JOIN h ON h.rn = t.rn AND h.kind = t.kind LEFT JOIN i ON i.rn = t.rn AND i.kind = t.kind)
SELECT e.doc_id, e.n_chars, m1.sha AS edited_sha256, array_to_string(m0.m, '-') AS fingerprint, array_to_string(m1.m, '-') AS edited_fingerprint,
       {_sql_like("m0.m", "m1.m")} AS near_edited, {_sql_like("m0.m", "m2.m")} AS near_next
FROM e JOIN m m0 ON m0.rn = e.rn AND m0.kind = 0 JOIN m m1 ON m1.rn = e.rn AND m1.kind = 1 JOIN m m2 ON m2.rn = e.nrn AND m2.kind = 0
"""

QUERIES = {"op1_imatch": op1_imatch}
ORACLES = {"op1_imatch": ORACLE}
