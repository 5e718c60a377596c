"""What the similarity joins share: link counts inside a block of pairs, and connected components.

A join task never emits its pairs. It returns one row per member: the number of linked partners
(weighted by their copies) and one representative of the member's component inside the task. The
rows (member, representative) are the edges from which `components` builds the global components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.runtime import durable


#: Up to this many distinct edges one task joins them; the bound is counted, not assumed.
ONE_TASK_EDGES = 200_000


def _one_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}
    kind = None

    def root(x):  # noqa: ANN001, ANN202
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for part in parts:
        kind = part.column(0).type
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; the component is its smallest node.

    Up to `one_task` distinct edges are joined in one task. Beyond that, alternates large-star and
    small-star steps, each a grouped minimum and an equi-join, until the edges no longer change; both
    ways give the same components. Every round is written to the shared folder. Loops and repeated edges
    are ignored; an empty table gives an empty result.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    if state[0] <= one_task:
        kind = dict(now.dtypes)["a"]
        return now.repartition(1).mapInArrow(_one_task, f"node {kind}, component {kind}")
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(down, large["a"] == down["u"]).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(small.union(down.select("u", "m")).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.join(now, roots["node"] == now["a"], "left_anti").union(now.select("a", "b"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


class Forest:
    """Union-find over positions, the smaller position as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def join_links(forest: Forest, links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Union the positions `rows[i]`, `cols[j]` wherever `links[i, j]`, without listing the pairs."""
    if not links.any():
        return
    far = np.iinfo(np.int64).max
    left, right = rows.astype(np.int64), cols.astype(np.int64)
    while True:
        new_left = np.minimum(left, np.where(links, right[None, :], far).min(1))
        new_right = np.minimum(right, np.where(links, new_left[:, None], far).min(0))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    for own, lab in ((rows, left), (cols, right)):
        for k in np.flatnonzero(own != lab):
            forest.join(int(own[k]), int(lab[k]))


def linked(classes: DataFrame, found: DataFrame) -> DataFrame:
    """One row per class: ck, label, n_links and `top`, the smallest label in the class's component.

    classes: (ck, label, copies) with labels of any type that has an order, none null. found: (ck,
    links, root), any number of rows per class. A class's copies link with each other.
    """
    found = durable(found, "links")
    sums = found.groupBy("ck").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("ck").alias("a"), F.col("root").alias("b")))
    full = classes.join(sums, "ck", "left").join(comps.withColumnRenamed("node", "ck"), "ck", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    alone = full.where("component IS NULL").select("ck", "label", n_links, F.col("label").alias("top"))
    joined = full.where("component IS NOT NULL")
    tops = joined.groupBy("component").agg(F.min("label").alias("top"))
    return alone.unionByName(joined.join(tops, "component").select("ck", "label", n_links, "top"))
