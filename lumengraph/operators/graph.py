"""Graph operators: degrees, reports, personalized rank, reachability and shortest paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.runtime import durable

#: Up to this many nodes and edges together the rank runs as one numeric kernel; beyond, as joins. The number is counted.
KERNEL_SIZE = 200_000
LEAST_RANK = 0.0001


def directory(path: Column) -> Column:
    """Parent directory with forward slashes; empty for a bare name."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def in_degree(edges: DataFrame) -> DataFrame:
    """References to every target over all relations."""
    return edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("refs"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("uses"))


def with_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with `refs`, 0 where nothing refers to them."""
    return nodes.join(in_degree(edges), "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def directory_stats(nodes: DataFrame) -> DataFrame:
    """Files and symbols per directory."""
    is_file = F.col("kind") == "File"
    return nodes.groupBy(directory(F.col("path")).alias("dir")).agg(F.count_if(is_file).alias("files"), F.count_if(~is_file).alias("symbols"))


def directory_hubs(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The most referred-to symbols of every directory; ties by insertion order."""
    ranked = with_refs(nodes.where("kind <> 'File'"), edges).where("refs > 0").withColumn("dir", directory(F.col("path")))
    w = Window.partitionBy("dir").orderBy(F.desc("refs"), "ord")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("dir", "place", "name", file_name(F.col("path")).alias("file"), "refs")


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """The most referred-to symbols of all."""
    ranked = with_refs(nodes.where("kind <> 'File'"), edges).where("refs > 0")
    return ranked.orderBy(F.desc("refs"), "ord").limit(k).select("name", "kind", F.translate("path", "\\", "/").alias("path"), "refs")


def repo_map(nodes: DataFrame, edges: DataFrame, max_dirs: int = 30) -> DataFrame:
    """The first directories by name with their counts and hubs, and a row that says how many were left out."""
    stats = directory_stats(nodes)
    hubs = directory_hubs(nodes, edges).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("place", "name", "file", "refs"))).alias("hubs"))
    label = F.concat_ws(", ", F.transform("hubs", lambda h: F.format_string("%s (%s, %d←)", h["name"], h["file"], h["refs"])))
    shown = stats.orderBy("dir").limit(max_dirs).join(hubs, "dir", "left").select("dir", "files", "symbols", F.coalesce(label, F.lit("")).alias("hubs"), F.lit(0).cast("bigint").alias("more"))
    rest = stats.agg((F.count("*") - max_dirs).alias("more")).where("more > 0").select(F.lit("~").alias("dir"), F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("symbols"), F.lit("").alias("hubs"), "more")
    return shown.union(rest)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends exist; parallel edges stay."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def _teleport(ids: list, seeds: dict) -> np.ndarray:
    p = np.array([seeds.get(i, 0.0) for i in ids])
    total = p.sum()
    return p / total if total > 0 else np.full(len(ids), 1 / max(len(ids), 1))


def rank(nodes: DataFrame, edges: DataFrame, seeds: list[tuple[str, float]], alpha: float = 0.25, iterations: int = 25, kernel_size: int = KERNEL_SIZE) -> DataFrame:
    """(id, score) above the least rank of a personalized walk that restarts with probability `alpha`.

    All relations count, parallel edges count each, confidence does not. Rank of nodes without an
    outgoing edge is dealt out by the restart weights. Without seeds the result is empty; seeds that
    are not nodes are ignored, and if none is one the restart is uniform.
    """
    spark = nodes.sparkSession
    weights: dict[str, float] = {}
    for i, w in seeds:
        weights[i] = weights.get(i, 0.0) + w
    if not weights:
        return spark.createDataFrame([], "id string, score double")
    # Nodes are numbered once; from there on an edge is two numbers.
    ids = durable(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()), "numbered")
    end = lambda name, to: ids.select(F.col("id").alias(name), F.col("n").alias(to))
    real = durable(edges.select("source", "target").join(end("source", "s"), "source").join(end("target", "t"), "target").select("s", "t"), "walk")
    seeded = {r.n: weights[r.id] for r in ids.where(F.col("id").isin(list(weights))).collect()}  # as many as seeds
    size = ids.count()
    ranks = (_kernel if real.count() + size <= kernel_size else _walk)(ids.select("n"), real, seeded, size, alpha, iterations)
    return ranks.where(F.col("score") > LEAST_RANK).join(ids, "n").select("id", "score")


def walked(n: int, s: np.ndarray, t: np.ndarray, p: np.ndarray, alpha: float = 0.25, iterations: int = 25) -> np.ndarray:
    """Ranks of `n` nodes whose edges go from places `s` to places `t`, restarting by `p`."""
    out = np.bincount(s, minlength=n)
    r = p.copy()
    for _ in range(iterations):
        spread = np.bincount(t, r[s] / out[s], n) if len(s) else np.zeros(n)
        r = (1 - alpha) * (spread + p * r[out == 0].sum()) + alpha * p
    return r


def _kernel(ids: DataFrame, edges: DataFrame, seeds: dict[int, float], size: int, alpha: float, iterations: int) -> DataFrame:
    rows = ids.select(F.col("n").alias("s"), F.lit(None).cast("bigint").alias("t")).unionByName(edges)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if not held:
            return
        frame = pd.concat(held)
        ids = np.sort(frame.loc[frame["t"].isna(), "s"].to_numpy(np.int64))
        links = frame[frame["t"].notna()]
        s, t = (np.searchsorted(ids, links[c].to_numpy(np.int64)) for c in ("s", "t"))
        yield pd.DataFrame({"n": ids, "score": walked(len(ids), s, t, _teleport(ids.tolist(), seeds), alpha, iterations)})

    return rows.repartition(1).mapInPandas(walk, "n bigint, score double")


def _walk(ids: DataFrame, edges: DataFrame, seeds: dict[int, float], size: int, alpha: float, iterations: int) -> DataFrame:
    """Rounds by joins. What no edge leaves holds what the others don't, since ranks always sum up to 1: only the last round works its ranks out."""
    total = sum(seeds.values())
    weight = F.coalesce(F.try_element_at(F.create_map(*[c for i, w in seeds.items() for c in (F.lit(i).cast("bigint"), F.lit(w).cast("double"))]), F.col("n")), F.lit(0.0)) if seeds else F.lit(0.0)
    p = weight / total if total > 0 else F.lit(1.0 / max(size, 1))
    ids = ids.withColumn("p", p)
    if not iterations:
        return ids.select("n", F.col("p").alias("score"))
    out = durable(edges.groupBy("s").agg((F.lit(1.0) / F.count("*")).alias("share")), "out")
    links = edges.join(out, "s")
    base = durable(ids.join(out.select(F.col("s").alias("n")), "n", "left_semi"), "base")
    inner = durable(links.join(out.select(F.col("s").alias("t")), "t", "left_semi").groupBy("s", "t").agg(F.sum("share").alias("share")), "links")

    def step(now: DataFrame, links: DataFrame, base: DataFrame) -> DataFrame:
        lost = F.broadcast(now.agg((F.lit(1.0) - F.coalesce(F.sum("r"), F.lit(0.0))).alias("lost")))  # one row
        sent = now.where("r <> 0").select(F.col("n").alias("s"), "r").join(links, "s").select(F.col("t").alias("n"), (F.col("r") * F.col("share")).alias("got"), F.lit(None).cast("double").alias("p"))
        whole = sent.union(base.select("n", F.lit(0.0).alias("got"), "p")).groupBy("n").agg(F.sum("got").alias("got"), F.max("p").alias("p"))
        return whole.join(lost).select("n", "p", ((1 - alpha) * (F.col("got") + F.col("p") * F.col("lost")) + alpha * F.col("p")).alias("r"))

    now = base.withColumn("r", F.col("p"))
    for _ in range(iterations - 1):
        # Each round is one job, written once: a lost executor costs no earlier round.
        now = durable(step(now, inner, base), "rank")
    return durable(step(now, links, ids), "rank").select("n", F.col("r").alias("score"))


def reachable(edges: DataFrame, start: str, most_hops: int | None = None) -> DataFrame:
    """(id, hops) of every node that directed edges reach from `start`, by frontier joins."""
    spark = edges.sparkSession
    pairs = durable(edges.select("source", "target").distinct(), "pairs")
    seen = durable(spark.createDataFrame([(start, 0)], "id string, hops int"), "seen")
    frontier, hop = seen, 0
    while most_hops is None or hop < most_hops:
        hop += 1
        new = frontier.join(pairs, frontier["id"] == pairs["source"]).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hops"))
        frontier = durable(new, "frontier")
        if frontier.isEmpty():
            break
        seen = durable(seen.union(frontier), "seen")
    return seen


def first_paths(edges: DataFrame, start: str, end: str | None = None, most_hops: int | None = None) -> DataFrame:
    """(id, hops, path) of the nodes that directed edges reach from `start`, each by its first shortest path.

    Of paths with as many hops the first is the one whose edges come first, compared from the start
    on, as a breadth-first search over edges in their order (`ord`, then target) finds it. The
    frontier carries its paths, so nothing is read back. Stops where `end` is reached.
    """
    spark = edges.sparkSession
    pairs = durable(edges.groupBy("source", "target").agg(F.min("ord").alias("ord")).withColumn("step", F.struct("ord", "target")).select("source", "target", "step"), "pairs")
    step = dict(pairs.dtypes)["step"]
    seen = durable(spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops"), F.array(F.lit(start)).alias("path"), F.array().cast(f"array<{step}>").alias("steps")), "seen")
    frontier, hop = seen, 0
    while most_hops is None or hop < most_hops:
        if end is not None and not frontier.where(F.col("id") == end).isEmpty():
            break
        hop += 1
        on = frontier.join(pairs, frontier["id"] == pairs["source"]).select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"), F.concat("steps", F.array("step")).alias("steps"))
        new = on.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by("path", "steps").alias("path"), F.min("steps").alias("steps"))
        frontier = durable(new.select("id", F.lit(hop).alias("hops"), "path", "steps"), "frontier")
        if frontier.isEmpty():
            break
        seen = durable(seen.union(frontier), "seen")
    return seen.select("id", "hops", "path")


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str) -> list[str] | None:
    """Nodes of the first shortest directed path; None if an end is unknown or there is no path."""
    if nodes.where(F.col("id").isin(start, end)).select("id").distinct().count() < len({start, end}):
        return None
    if start == end:
        return [start]
    found = first_paths(edges, start, end).where(F.col("id") == end).first()
    return None if found is None else found.path


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Incident edges of a node with their direction: in, out or loop."""
    mine = edges.where((F.col("source") == node) | (F.col("target") == node))
    side = F.when(F.col("source") == F.col("target"), "loop").when(F.col("source") == node, "out").otherwise("in")
    return mine.select("source", "target", "relation", side.alias("direction"))


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources (nothing refers to them), leaves (they refer to nothing), hubs (both) and isolated nodes."""
    rows = with_refs(nodes, edges).join(out_degree(edges), "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    role = F.when((F.col("refs") == 0) & (F.col("uses") == 0), "isolated").when(F.col("refs") == 0, "source").when(F.col("uses") == 0, "leaf").otherwise("hub")
    return rows.select("id", "refs", "uses", role.alias("role"))


def node(nodes: DataFrame, wanted: str) -> DataFrame:
    """The node with this id: none or one."""
    return nodes.where(F.col("id") == wanted).limit(1)


def focus(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges to show for chosen nodes (id): one node's incident edges, or the edges among several."""
    ids = chosen.select("id").distinct()
    if ids.count() == 1:
        one = ids.first().id
        return edges.where((F.col("source") == one) | (F.col("target") == one))
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def adjacent(edges: DataFrame, node: str) -> DataFrame:
    """(id) of a node and all that an edge ties to it."""
    mine = edges.where((F.col("source") == node) | (F.col("target") == node))
    return mine.select(F.explode(F.array("source", "target")).alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()
