"""Strong parts and layers of whole graphs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumengraph.operators import layering
from lumengraph.runtime import written


def reached(nodes, edges):
    """What each node leads to, itself included."""
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in out and b in out and not out[b] <= out[a]:
                out[a] |= out[b]
                changed = True
    return out


def expected(nodes, edges):
    to = reached(nodes, edges)
    part = {n: min(m for m in to[n] if n in to[m]) for n in nodes}
    between = {(part[a], part[b]) for a, b in edges if a in part and b in part and part[a] != part[b]}
    level = dict.fromkeys(part.values(), 0)
    for _ in level:
        for a, b in between:
            level[b] = max(level[b], level[a] + 1)
    return {n: (part[n], level[part[n]]) for n in nodes}


def got(spark, nodes, edges):
    frame = spark.createDataFrame([(n,) for n in nodes], "id string")
    links = spark.createDataFrame(edges, "source string, target string").selectExpr("source", "target", "'Calls' AS relation")
    return {r.id: (r.part, r.layer) for r in layering.layers(frame, links).collect()}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 30), (3, 40, 60)])
def test_layers_equal_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(n)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)]
    edges += edges[:5] + [(nodes[0], nodes[0]), (nodes[1], "unknown"), ("unknown", nodes[2]), (None, nodes[3])]
    assert got(spark, [*nodes, nodes[0]], edges) == expected(nodes, [e for e in edges if e[0]])


def test_cycles_in_a_row(spark):
    """Three cycles, each leading to the next, named so that colours run through them; a chain in front and behind."""
    edges, nodes = [], []
    for k in range(3):
        own = [f"{2 - k}{x}" if k % 2 else f"{k}{x}" for x in "abc"]
        own = [f"c{k}-{x}" for x in own]
        edges += [*zip(own, own[1:] + own[:1], strict=True)]
        edges += [(nodes[-1], own[0])] if nodes else []
        nodes += own
    edges += [("z1", "z2"), ("z2", nodes[0]), (nodes[-1], "a1"), ("a1", "a2")]
    nodes += ["z1", "z2", "a1", "a2", "alone"]
    found = got(spark, nodes, edges)
    assert found == expected(nodes, edges)
    assert found["a2"][1] == 6 and found["alone"] == ("alone", 0)


def test_empty_graphs_and_what_is_left_behind(spark):
    assert got(spark, [], []) == {}
    before = len(written())
    assert got(spark, ["b", "a"], []) == {"a": ("a", 0), "b": ("b", 0)}
    assert len(written()) == before + 1  # the result alone


def test_rounds_keep_to_what_leads_on(spark, monkeypatch):
    """What nothing enters and what leads nowhere stay out of the rounds; the edges are worked out once."""
    sizes = []
    cycles, peeled = layering._cycles, layering._peeled
    monkeypatch.setattr(layering, "_cycles", lambda live: sizes.append(live.count()) or cycles(live))
    monkeypatch.setattr(layering, "_peeled", lambda parts, links: sizes.append(links.count()) or peeled(parts, links))
    read = spark.sparkContext.accumulator(0)
    wide = [("top", f"leaf{k}") for k in range(50)] + [("top", "m1"), ("m1", "m2"), ("m2", "m1"), ("m2", "m3"), ("m3", "leaf0"), ("alone", "leaf1")]
    links = spark.createDataFrame(wide, "source string, target string")
    counted = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    nodes = sorted({x for edge in wide for x in edge})
    found = {r.id: (r.part, r.layer) for r in layering.layers(spark.createDataFrame([(n,) for n in nodes], "id string"), links.withColumn("target", counted("target"))).collect()}
    assert found == expected(nodes, wide)
    assert sizes == [3, 2] and read.value == len(wide)
