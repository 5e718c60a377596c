"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to unit length, so cosine >= c means distance <= eps = sqrt(2 - 2c). A rotation
onto the principal directions (covariance summed over all vectors) keeps distances. Vectors are
sorted by their grid cells of width eps on the leading principal dimensions and cut into blocks
along that order. Two blocks meet only if their cells on the first dimension touch (an equi-join)
and their bounding boxes are at most eps apart. Neighbouring blocks form groups and a task takes a
pair of groups, so a block travels once per group that it meets and not once per partner. Within a
meeting, both intervals are halved recursively and parts whose boxes are more than eps apart are
skipped. In what is left a product over the leading dimensions plus the product of the remaining
lengths bounds each cosine from above; pairs that pass the bound are compared in double precision.
Tasks return link counts and local components, never pairs. Equal vectors are one class and are
compared once.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link. Repeated rows are copies. Rows whose id is null
count like others; a component in which every id is null has a null component_id. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm.groups import Forest, join_links, linked
from lumengraph.runtime import durable, table

COSINE = 0.9
#: Vectors in a block, in a recursion leaf, and the dimensions that order the sequence.
BLOCK, LEAF, LEADING = 4096, 512, 6
#: Share of the dimensions whose products bound a cosine from above (the rest by its length).
HEAD = 0.375
#: What the bound's single precision may be short of.
BOUND_SLACK = 1e-4
#: Blocks in a group; a task holds two groups.
GROUP = 4
#: Slack on distances for the rounding of rotation and boxes; comparisons themselves have none.
SLACK = 1e-9


def _scaled(grid: np.ndarray) -> np.ndarray:
    """Rows at unit length; very small and very large rows are first brought into range."""
    norm = np.sqrt((grid * grid).sum(1, keepdims=True))
    if not np.isfinite(norm).all() or (norm < 1e-150).any():
        grid = grid / np.maximum(np.abs(grid).max(1, keepdims=True), np.finfo(float).tiny)
        norm = np.sqrt((grid * grid).sum(1, keepdims=True))
    return grid / norm


def _grid(rows: list, size: int) -> np.ndarray:
    if rows and all(len(r) == size for r in rows):
        return np.stack(rows)
    grid = np.zeros((len(rows), size), rows[0].dtype if rows else float)
    for k, row in enumerate(rows):
        grid[k, : len(row)] = row
    return grid


def _unit(rows: list, size: int) -> np.ndarray:
    return _scaled(_grid(rows, size).astype(np.float64))


def _moments(size: int):
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for part in parts:
            if len(part):
                x = np.hstack([_unit(part["vector"].tolist(), size), np.ones((len(part), 1))])
                total += x.T @ x
        yield pd.DataFrame({"sums": [total.ravel()]})

    return add


def rotation(classes: DataFrame, size: int) -> np.ndarray:
    """Principal directions as columns, widest first, from moments summed over all vectors."""
    parts = classes.select("vector").mapInPandas(_moments(size), "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    flat = np.zeros((size + 1) ** 2)
    for row in sums.collect():  # (size + 1) squared numbers, whatever the number of vectors
        flat[row.pos] = row.x
    m = flat.reshape(size + 1, size + 1)
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    _, directions = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(directions[:, ::-1])


def _cells(turn: np.ndarray, eps: float, leading: int):
    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _unit(part["vector"].tolist(), len(turn)) @ turn[:, :leading] if len(part) else np.zeros((0, leading))
            yield part.assign(cells=list(np.floor(x / eps).astype(np.int64)))

    return cells


def _number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the partition and the place in it."""
    task, at = TaskContext.get().partitionId(), 0
    for part in parts:
        yield part.assign(part=task, at=np.arange(at, at + len(part)))
        at += len(part)


def _packer(turn: np.ndarray, eps: float):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        raw = _grid(rows["vector"].tolist(), len(turn))
        x = _scaled(raw.astype(np.float64)) @ turn
        low, high = x.min(0), x.max(0)
        wide = raw.dtype != np.float32
        return pd.DataFrame(
            {"block": [int(rows["block"].iat[0])], "size": [int(rows["size"].iat[0])], "low": [low], "high": [high], "first": [int(np.floor(low[0] / eps))], "last": [int(np.floor(high[0] / eps))],
             "cks": [b"".join(rows["ck"])], "copies": [rows["copies"].to_numpy(np.int64)], "vectors": [(raw.astype(np.float64) if wide else raw).tobytes()], "wide": [wide]}
        )

    return pack


_BLOCK = "block bigint, size int, low array<double>, high array<double>, first bigint, last bigint, cks binary, copies array<bigint>, vectors binary, wide boolean"


def _apart(low1: np.ndarray, high1: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low1 - high2, low2 - high1))
    return float(np.sqrt((gap * gap).sum()))


def _joiner(turn: np.ndarray, cosine: float, leaf: int):
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    head = max(1, round(HEAD * len(turn)))

    def load(row):  # noqa: ANN001, ANN202
        raw = np.frombuffer(row.vectors, np.float64 if row.wide else np.float32)
        unit = _scaled(raw.reshape(-1, len(turn)).astype(np.float64))
        turned = unit @ turn
        tail = np.sqrt(np.maximum(0, (turned[:, head:] ** 2).sum(1, keepdims=True)))
        return unit, turned, [row.cks[k : k + 16] for k in range(0, len(row.cks), 16)], np.asarray(row.copies, float), np.hstack([turned[:, :head], tail]).astype(np.float32)

    def compare(one: tuple, two: tuple, a: int, b: int, c: int, d: int, upper: bool) -> np.ndarray:
        """Links of two intervals: a bound from the leading dimensions, then exact cosines of what passes it."""
        rows, cols = np.nonzero(one[4][a:b] @ two[4][c:d].T >= np.float32(cosine - BOUND_SLACK))
        links = np.zeros((b - a, d - c), bool)
        for at in range(0, len(rows), 1 << 16):
            r, k = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            if upper:
                r, k = r[r < k], k[r < k]
            links[r, k] = np.einsum("ij,ij->i", one[0][a + r], two[0][c + k]) >= cosine
        return links

    def meet(one: tuple, two: tuple, same: bool, shift: int, base: int, forest: Forest, counts: np.ndarray) -> None:
        """Adds the links of two blocks, whose vectors stand from `base` and `shift` in the task."""
        stack = [(0, len(one[2]), 0, len(two[2]))]
        while stack:
            a, b, c, d = stack.pop()
            if same and a > c:
                continue
            p, q = one[1][a:b], two[1][c:d]
            if _apart(p.min(0), p.max(0), q.min(0), q.max(0)) > eps:
                continue
            if b - a <= leaf and d - c <= leaf:
                links = compare(one, two, a, b, c, d, same and a == c)
                if links.any():
                    rows, cols = np.arange(a, b) + base, np.arange(c, d) + shift
                    counts[rows] += links @ two[3][c:d]
                    counts[cols] += links.T @ one[3][a:b]
                    join_links(forest, links, rows, cols)
                continue
            halves1 = [(a, b)] if b - a <= leaf else [(a, (a + b) // 2), ((a + b) // 2, b)]
            halves2 = [(c, d)] if d - c <= leaf else [(c, (c + d) // 2), ((c + d) // 2, d)]
            stack += [(*x, *y) for x in halves1 for y in halves2]

    def join(part: pd.DataFrame) -> pd.DataFrame:
        """Links of all blocks of one group with those of another, or of a group's blocks among themselves."""
        part = part.sort_values("block")
        loaded = [load(row) for row in part.itertuples()]
        first = np.cumsum([0, *(len(x[2]) for x in loaded)])
        forest, counts = Forest(int(first[-1])), np.zeros(int(first[-1]))
        g1, g2 = int(part["g1"].iat[0]), int(part["g2"].iat[0])
        own = part["own"].tolist()
        for i in range(len(loaded)):
            for j in range(i, len(loaded)):
                if {own[i], own[j]} == {g1, g2}:
                    meet(loaded[i], loaded[j], i == j, int(first[j]), int(first[i]), forest, counts)
        names = [ck for x in loaded for ck in x[2]]
        out = [(names[k], int(counts[k]), names[forest.root(int(k))]) for k in np.flatnonzero(counts)]
        return pd.DataFrame(out, columns=["ck", "links", "root"])

    return join


def epsilon_join(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, leaf: int = LEAF, leading: int = LEADING) -> DataFrame:
    """Per row of `vectors(vec_id, embedding)`: vec_id, copy_of, n_links and component_id."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    clean = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    ck = F.when(usable, F.unhex(F.md5(F.concat_ws(",", clean.cast("array<string>")).cast("binary"))))
    members = durable(vectors.select("vec_id", ck.alias("ck"), F.when(usable, F.col("embedding")).alias("vector")), "vectors")
    classes = durable(members.where("ck IS NOT NULL").groupBy("ck").agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))).alias("label"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("size", F.size("vector")), "classes")
    widest = classes.agg(F.max("size")).first()[0]
    result = "ck binary, links bigint, root binary"
    if widest is None:
        return _told(members, classes, spark.createDataFrame([], result))
    turn = rotation(classes, widest)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    leading = min(leading, widest)
    listed = classes.select("ck", "copies", "size", "vector").mapInPandas(_cells(turn, eps, leading), f"ck binary, copies bigint, size int, vector {kind}, cells array<bigint>")
    ordered = durable(listed, "cells").orderBy("size", *[F.col("cells")[k] for k in range(leading)], "ck").select("ck", "copies", "size", "vector")
    ordered = durable(ordered.mapInPandas(_number, f"ck binary, copies bigint, size int, vector {kind}, part int, at bigint"), "ordered")
    # Places in the whole sequence: a partition's place plus how many rows the partitions before it have.
    before, offsets = 0, []
    for row in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        offsets.append((row.part, before))
        before += row.n
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, start bigint"))
    ranked = ordered.join(starts, "part").withColumn("rank", F.col("start") + F.col("at"))
    # Sequences of different lengths never share a block.
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block) * 65_536 + F.col("size") % 65_536)
    blocks = durable(ranked.select("block", "size", "rank", "ck", "copies", "vector").groupBy("block").applyInPandas(_packer(turn, eps), _BLOCK), "blocks")
    boxes = blocks.select("block", "size", "low", "high", "first", "last")
    one = boxes.select(*[F.col(c).alias(f"{c}1") for c in boxes.columns], F.explode(F.sequence("first", "last")).alias("cell"))
    two = boxes.select(*[F.col(c).alias(f"{c}2") for c in boxes.columns], F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"))
    gap = F.aggregate(F.zip_with(F.zip_with("low1", "high2", lambda x, y: x - y), F.zip_with("low2", "high1", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    pairs = one.join(two, "cell").where("block1 <= block2 AND size1 = size2").where(gap <= eps * eps).select("block1", "block2").distinct()
    # A group holds GROUP neighbouring places of the sequence; vectors of another length are another group.
    grouped = lambda c: F.floor(F.floor(F.col(c) / 65_536) / GROUP) * 65_536 + F.col(c) % 65_536
    tasks = pairs.select(grouped("block1").alias("g1"), grouped("block2").alias("g2"), F.array("block1", "block2").alias("both"))
    needs = durable(tasks.select("g1", "g2", F.explode("both").alias("block")).distinct().withColumn("own", grouped("block")), "needs")
    full = needs.join(blocks.select("block", "cks", "copies", "vectors", "wide"), "block")
    found = full.groupBy("g1", "g2").applyInPandas(_joiner(turn, cosine, leaf), result)
    return _told(members, classes, found)


def _told(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    full = linked(classes.select("ck", "label", "copies"), found)
    some = members.where("ck IS NOT NULL").select("vec_id", "ck").join(full, "ck")
    some = some.select("vec_id", F.col("label.id").alias("copy_of"), F.col("n_links").cast("bigint").alias("n_links"), F.col("top.id").alias("component_id"))
    none = members.where("ck IS NULL")
    return some.unionByName(none.select("vec_id", F.col("vec_id").alias("copy_of"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))


def op4_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it stays for every vector, cosine of 0.9 or more."""
    return epsilon_join(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op4_epsilon_grid": op4_epsilon_grid}
ORACLES: dict[str, str] = {}
