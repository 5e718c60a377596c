"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words. Sources share the whole size by weight, none above `cap` times its own size; what a
capped source leaves is shared by the others by weight, until none is above. That end state is a
water level: target = min(cap * size, level * weight). The level follows from running sums over the
sources in the order in which they are capped.

A source's repetition rate is target / size. A document is taken floor(rate) times, plus once more
where a uniform number hashed from a seed, its id and its text is below the rate's fraction. Of `SEEDS` seeds a
source takes the one whose taken words come nearest to its target; all of them are summed up in one
aggregation, so every document keeps its own independent draw.

Edge cases: a null text has size 0 and is taken like any other document. A null source is a source
of its own, after all others. A source without words has target 0 and is not taken. Documents with
one id, or none, draw by their texts; exact repeats draw alike. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm.arrow import whole
from lumengraph.runtime import durable, table

WEIGHTS, CAP, SEEDS = (1, 2, 3), 3, 16


def size(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def key(doc_id: Column, text: Column) -> Column:
    """What a document draws by."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) from a seed and a document's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of `sizes(source, size)`: of (the source), source_size, target, rate. The windows run over one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    most = (F.col("source_size") * cap).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("most", most)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "capped": F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "gone": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything),
    })
    level = (F.col("all_size") - F.coalesce("capped", F.lit(0.0))) / (F.col("all_weight") - F.coalesce("gone", F.lit(0.0)))
    # The first source in this order whose share at the level stays within its cap sets the level.
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("most") / F.col("weight"))).over(everything))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return rows.select(F.col("source").alias("of"), "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, seed: Column, key: Column) -> Column:
    """How often a document is taken."""
    uniform = F.element_at(F.array(*[draw(k, key) for k in range(SEEDS)]), seed + 1)
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def seeded(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` with `seed`: per source the one whose taken words are nearest to the target."""
    rows = sizes.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "key", "rate", "target")
    fraction = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(draw(k, F.col("key")) < fraction, F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(SEEDS)]
    sums = rows.groupBy("source").agg(*taken, F.sum(F.col("size") * F.floor("rate")).alias("whole"), F.first("target").alias("target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("whole") + F.col(f"t{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    picked = sums.select(F.col("source").alias("picked"), best["seed"].alias("seed"))
    return wanted.join(picked, F.col("of").eqNullSafe(F.col("picked"))).drop("picked")


def plan(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text, source)`: doc_id, size, source_size, target, copies."""
    sizes = durable(docs.select("doc_id", "source", size(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key")), "sizes")
    wanted = durable(seeded(sizes, targets(sizes)), "targets")
    rows = sizes.join(wanted, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", copies(F.col("rate"), F.col("seed"), F.col("key")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """`docs`, each row as often as the mix takes it."""
    sizes = durable(docs.select("source", size(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key")), "sizes")
    wanted = durable(seeded(sizes, targets(sizes)), "targets").select("of", "rate", "seed")
    rows = docs.select(whole(docs).alias("doc")).join(wanted, F.col("doc.source").eqNullSafe(F.col("of")))
    times = copies(F.col("rate"), F.col("seed"), key(F.col("doc.doc_id"), F.col("doc.text"))).cast("int")
    return rows.select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document."""
    docs = table(spark, sf_dir, "documents")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_DRAW = "('0x' || substr(md5({k} || ':' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
ORACLE = rf"""
WITH z AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM z GROUP BY source),
o AS (SELECT *, (source_size * {CAP})::DOUBLE AS most FROM s),
r AS (SELECT *, coalesce(sum(most) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
      FROM o WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (all_size - capped) / (all_weight - gone) AS level FROM r WHERE (all_size - capped) / (all_weight - gone) * weight <= most ORDER BY most / weight LIMIT 1),
t AS (SELECT source, source_size, least(most, (SELECT level FROM l) * weight) AS target FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT unnest(range(0, {SEEDS})) AS k),
d AS (SELECT z.source, k.k, sum(size * (floor(rate) + CASE WHEN {_DRAW.format(k="k.k")} < rate - floor(rate) THEN 1 ELSE 0 END)) AS took, any_value(target) AS target
      FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source CROSS JOIN k GROUP BY z.source, k.k),
b AS (SELECT source, arg_min(k, struct_pack(miss := abs(took - target), k := k)) AS k FROM d GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN {_DRAW.format(k="b.k")} < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source JOIN b ON b.source IS NOT DISTINCT FROM z.source
"""

QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": ORACLE}
