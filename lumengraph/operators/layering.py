"""Layers of a whole graph: cycles become one part each, then every part lies below all that lead to it.

All steps are equi-joins and groupings of edges, without a bound on nodes. Nodes are numbered once. Rounds
run over what both is led to and leads on; they grow with the longest way (peeling, trimming) and with the
width of cycles (colours), not with the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.runtime import discard, durable, written

#: Stands in front of all parts that an edge from outside the rounds enters; no node has this number.
OUTSIDE = -1


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: both ends are entered and left by edges that can. Rounds until none goes."""
    left = edges.count()
    while left:
        both = durable(_inner(edges), "both")
        edges = durable(_among(edges, both), "trimmed")
        before, left = left, edges.count()
        if left == before:
            break
    return edges


def _inner(edges: DataFrame) -> DataFrame:
    """(id) of what edges both enter and leave."""
    return edges.select(F.col("source").alias("id")).distinct().join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_semi")


def _among(edges: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges whose ends are both among (or both not among) `ids(id)`."""
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, how)
    return edges.select("source", "target")


def _colours(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest id that leads to a node, its own included."""
    now = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("new"))
    while True:
        # Only what changed in the last round is sent on.
        sent = now.where("new").select(F.col("id").alias("source"), "colour").join(edges, "source").select(F.col("target").alias("id"), F.col("colour").alias("got"))
        best = sent.groupBy("id").agg(F.min("got").alias("got"))
        better = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
        now = durable(now.join(best, "id", "left").select("id", F.when(better, F.col("got")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), "colours")
        if now.where("new").isEmpty():
            return now.select("id", "colour")


def _backward(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(id, part): the nodes of each colour that lead back to the node which gave it."""
    at = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
    same = edges.join(at("source"), "source").join(at("target"), "target").where("source_colour = target_colour")
    back = durable(same.select("source", "target"), "back")
    frontier = seen = durable(colours.where("id = colour").select("id", F.col("colour").alias("part")), "roots")
    while not frontier.isEmpty():
        new = frontier.select(F.col("id").alias("target"), "part").join(back, "target").select(F.col("source").alias("id"), "part").distinct()
        frontier = durable(new.join(seen, "id", "left_anti"), "behind")
        seen = seen.union(frontier)
    return seen


def strong_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, part) of every node of `nodes(id)`: two nodes have one part if each leads to the other.

    A part is named by its smallest id; a node on no cycle is a part of its own. Edges with an end that
    is no node (or null), loops and repeated edges say nothing. Repeated nodes count once.
    """
    ids, live = _numbered(nodes, edges)
    found = _cycles(durable(_among(live, durable(_inner(live), "inner")), "live"))
    return (ids.withColumn("part", F.col("id")) if found is None else _named(ids, found)).select("id", "part")


def _numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (n, id), each once, and the edges (source, target) between different ones as numbers, each once."""
    ids = durable(nodes.where("id IS NOT NULL").select("id").distinct().select(F.monotonically_increasing_id().alias("n"), "id"), "ids")
    end = lambda name: ids.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"))
    real = edges.where("source <> target").select("source", "target").join(end("source"), "source").join(end("target"), "target")
    return ids, durable(real.select(F.col("source_n").alias("source"), F.col("target_n").alias("target")).distinct(), "between")


def _cycles(live: DataFrame) -> DataFrame | None:
    """(id, part) of the nodes on cycles, a part named by one of them; None where there is no cycle.

    What lies on no cycle is trimmed away. Each node left takes the smallest id that leads to it as its
    colour; those of a colour that lead back to the node which gave it are one part. The rest goes around again.
    """
    parts = None
    while not (live := _trimmed(live)).isEmpty():
        found = durable(_backward(live, _colours(live)), "parts")
        parts = found if parts is None else parts.union(found)
        live = durable(_among(live, found, "left_anti"), "live")
    return parts


def _peeled(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, layer) of `parts(part)` by the edges (source, target) between them, cycles aside.

    What leads on and is not entered is taken off round by round, with the edges that leave it; what leads
    nowhere comes last and lies below the deepest of what leads to it.
    """
    live, done, layer = edges, None, 0
    while not live.isEmpty():
        entered = live.select(F.col("target").alias("source")).distinct().withColumn("entered", F.lit(True))
        # One table a round: the edges that leave what is free, and those that stay.
        now = durable(live.join(entered, "source", "left").select("source", "target", F.col("entered").isNull().alias("free")), "peeled")
        free = now.where("free").select(F.col("source").alias("part"), "target", F.lit(layer).alias("layer"))
        done = free if done is None else done.union(free)
        live = now.where("NOT free").select("source", "target")
        layer += 1
    if done is None:
        return parts.select("part", F.lit(0).alias("layer"))
    at = done.select("part", "layer").union(done.select(F.col("target").alias("part"), F.col("layer") + 1))
    return parts.join(at.groupBy("part").agg(F.max("layer").alias("layer")), "part", "left").select("part", F.coalesce("layer", F.lit(0)).alias("layer"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, part, layer): the length of the longest way to a node's part from a part that nothing enters.

    Parts as `strong_parts` gives them; the nodes of a cycle share a layer. An empty graph gives no row.
    Only what both is entered and leads on goes through the rounds: what nothing enters lies on top, and
    what leads nowhere right below the deepest node that leads to it.
    """
    before = written()
    ids, real = _numbered(nodes, edges)
    inner = durable(_inner(real), "inner")
    between = durable(_among(real, inner), "live")
    found = _cycles(between)
    core = inner.select("id", F.col("id").alias("part"))
    if found is not None:
        core = durable(inner.join(found, "id", "left").select("id", F.coalesce("part", "id").alias("part")), "core")
    of = lambda end: core.select(F.col("id").alias(end), F.col("part").alias(f"{end}_part"))
    links = between.join(of("source"), "source").join(of("target"), "target").where("source_part <> target_part").select(F.col("source_part").alias("source"), F.col("target_part").alias("target"))
    outer = real.join(inner.select(F.col("id").alias("source")), "source", "left_anti").join(of("target"), "target").select(F.lit(OUTSIDE).cast("bigint").alias("source"), F.col("target_part").alias("target"))
    levels = _peeled(core.select("part").distinct(), durable(links.union(outer).distinct(), "links"))
    placed = durable(core.join(levels, "part").select(F.col("id").alias("n"), "layer"), "placed")
    ends = real.join(inner.select(F.col("id").alias("target")), "target", "left_anti").join(placed.select(F.col("n").alias("source"), "layer"), "source", "left")
    ends = ends.groupBy(F.col("target").alias("n")).agg((F.coalesce(F.max("layer"), F.lit(0)) + 1).alias("layer"))
    rows = placed.select("n", "layer").union(ends)
    named = _named(ids, found) if found is not None else ids.select("n", "id", F.col("id").alias("part"))
    whole = durable(named.join(rows, "n", "left").select("id", "part", F.coalesce("layer", F.lit(0)).alias("layer")), "layers")
    discard(nodes.sparkSession, [p for p in written() if p not in before][:-1])
    return whole


def _named(ids: DataFrame, found: DataFrame) -> DataFrame:
    """(n, id, part) of all nodes: a part of several is named by its smallest id, all else by itself."""
    members = found.select(F.col("id").alias("n"), F.col("part").alias("p"))
    names = members.join(ids, "n").groupBy("p").agg(F.min("id").alias("part"))
    return ids.join(members.join(names, "p").select("n", "part"), "n", "left").select("n", "id", F.coalesce("part", "id").alias("part"))
