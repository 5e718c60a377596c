"""Call sequences: who calls whom from a root function, in the order in which the calls are read.

The walk goes down joins, one per step, for any number of roots at once. A place in it is the array
of the ranks that its calls have among their callers' calls, so that sorting places gives reading
order: a caller's calls first, then what its first callee does, and so on. A function is opened once,
where it is reached first; what hangs below a place that isn't opened is not reached. One fold over
the sorted places of a root decides that. It holds at most 1 + most + most ^ 2 + ... places, whatever
the graph's size, since no caller shows more calls than there are messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.runtime import durable

DEPTH, MESSAGES = 3, 30
_STATE = "struct<opened:array<string>,places:array<array<int>>,said:array<struct<source:string,target:string>>>"


def _step(state: Column, x: Column, most: int) -> Column:
    """The state after the place `x`: opened functions, their places, messages so far."""
    above = F.slice(x["place"], F.lit(1), F.greatest(F.size(x["place"]) - 1, F.lit(0)))
    reached = (F.size(x["place"]) == 0) | F.array_contains(state["places"], above)
    opens = reached & ~F.array_contains(state["opened"], x["id"]) & (F.size(state["said"]) < most)
    said = F.slice(F.concat(state["said"], F.transform(x["calls"], lambda c: F.struct(x["id"].alias("source"), c["target"].alias("target")))), 1, most)
    after = F.struct(F.concat(state["opened"], F.array(x["id"])).alias("opened"), F.concat(state["places"], F.array(x["place"])).alias("places"), said.alias("said"))
    return F.when(opens, after.cast(_STATE)).otherwise(state)


def messages(calls: DataFrame, roots: DataFrame, known: DataFrame | None = None, depth: int = DEPTH, most: int = MESSAGES) -> DataFrame:
    """(root, place, source, target): up to `most` messages of each root, from 1 on, `depth` calls deep.

    calls: source, target and ord, which may be of any type that has an order; equal ones are told
    apart by target. roots: (id). known: (id), the only functions that count as called. A root that
    calls nothing has no row; repeated roots count once.
    """
    now = roots.select(F.col("id").alias("root"), "id").distinct().withColumn("place", F.array().cast("array<int>"))
    reached = None
    for _ in range(depth):
        found = now.join(calls.select(F.col("source").alias("id"), "target", "ord"), "id")
        if known is not None:
            found = found.join(known.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
        rank = F.row_number().over(Window.partitionBy("root", "place").orderBy("ord", "target"))
        found = durable(found.withColumn("rank", rank).where(F.col("rank") <= most).select("root", "place", "id", "rank", "target"), "calls")
        own = found.groupBy("root", "place", "id").agg(F.array_sort(F.collect_list(F.struct("rank", "target"))).alias("calls"))
        reached = own if reached is None else reached.union(own)
        now = found.select("root", F.col("target").alias("id"), F.concat("place", F.array("rank")).alias("place"))
    places = F.array_sort(F.collect_list(F.struct("place", "id", "calls")))
    start = F.struct(F.array(), F.array(), F.array()).cast(_STATE)
    said = F.aggregate("places", start, lambda state, x: _step(state, x, most))["said"]
    rows = reached.groupBy("root").agg(places.alias("places")).select("root", F.posexplode(said).alias("at", "x"))
    return rows.select("root", (F.col("at") + 1).cast("bigint").alias("place"), "x.source", "x.target")
