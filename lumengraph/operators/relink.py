"""Resolution that follows changes: only calls whose candidates may have changed are resolved anew.

What a call resolves to depends on its own row, on the definitions under its keys in each tier and on
the pairs (imports, package dependencies) it goes through. So a change touches the calls of changed
files, the calls that meet a key under which definitions came or went, and the calls whose pairs
differ. A file that is edited without a change to its definitions touches its own calls alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.operators.resolve import Rules, Tier, resolve
from lumengraph.runtime import durable

_CALL = ["caller", "tok_ord"]


@dataclass
class State:
    """What `resolve` is given; calls and definitions have a column `file`, and both states the same tiers."""

    calls: DataFrame
    definitions: DataFrame
    rules: Rules


def changed_files(before: State, after: State) -> DataFrame:
    """(file) whose calls or definitions are not what they were, by one sum of row hashes for each file.

    The rows of a file count with all their columns: a file that moved to another package has changed.
    """
    sums = None
    for state, side in ((before, "old"), (after, "new")):
        for part, df in enumerate((state.calls, state.definitions)):
            same = (before.calls, before.definitions)[part].columns  # hashes are of columns in one order
            mark = F.xxhash64(F.lit(part), *same).cast("decimal(38,0)")
            one = df.select("file", *[(mark if s == side else F.lit(0).cast("decimal(38,0)")).alias(s) for s in ("old", "new")])
            sums = one if sums is None else sums.union(one)
    return sums.groupBy("file").agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where("old <> new").select("file")


def _differ(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, as often as they are lacking."""
    return old.exceptAll(new).union(new.exceptAll(old))


def _keys(before: State, after: State, changed: DataFrame, number: int) -> DataFrame:
    """(name, key columns) of a tier under which definitions came or went."""
    sides = []
    for state in (before, after):
        tier = state.rules.tiers[number]
        defs = tier.definitions if tier.definitions is not None else state.definitions
        sides.append(defs.join(changed, "file", "left_semi").select("id", "name", *tier.keys))
    return _differ(*sides).select("name", *after.rules.tiers[number].keys).distinct()


def _met(mine: DataFrame, tier: Tier, keys: DataFrame) -> DataFrame:
    """(caller, tok_ord) of the calls that meet one of these keys in the tier."""
    on = ["name", *tier.keys]
    direct = mine.join(keys, on, "left_semi").select(*_CALL)
    if tier.via is None:
        return direct
    column, other = tier.over
    led = keys.withColumnRenamed(column, other)
    # Both sides are cut down before they meet: calls to the names, pairs to the ends in question.
    pairs = tier.via.distinct().join(led.select(other).distinct(), other, "left_semi")
    found = mine.join(keys.select("name").distinct(), "name", "left_semi").join(pairs, column).join(led, [other if k == column else k for k in on], "left_semi").select(*_CALL)
    return found.union(direct) if tier.own_too else found


def touched(before: State, after: State, changed: DataFrame) -> DataFrame:
    """(caller, tok_ord) of the calls of `after` whose target may differ from what it was."""
    found = after.calls.join(changed, "file", "left_semi").select(*_CALL)
    for number, (old, new) in enumerate(zip(before.rules.tiers, after.rules.tiers, strict=True)):
        mine = after.calls if new.calls is None else new.calls
        mine = mine.select(*_CALL, "name", *new.keys)
        found = found.union(_met(mine, new, durable(_keys(before, after, changed, number), "keys")))
        if new.via is not None:
            column = new.over[0]
            moved = _differ(old.via.select(*new.over).distinct(), new.via.select(*new.over).distinct())
            found = found.union(mine.join(moved.select(column).distinct(), column, "left_semi").select(*_CALL))
        if new.calls is not None:
            found = found.union(_differ(old.calls.select(*mine.columns), mine).select(*_CALL))
    return found.distinct()


def relink(resolved: DataFrame, before: State, after: State, changed: DataFrame | None = None) -> DataFrame:
    """What `resolve` gives for `after`, from `resolved`, which it gave for `before`.

    changed: (file) of all files whose calls or definitions differ, new and deleted ones among them;
    found by `changed_files` where it is not given. A call that is no more has no row.
    """
    changed = durable((changed_files(before, after) if changed is None else changed).select("file").distinct(), "changed")
    again = durable(touched(before, after, changed), "touched")
    names = after.calls.join(again, _CALL, "left_semi").select("name")
    for tier in after.rules.tiers:
        if tier.calls is not None:
            names = names.union(tier.calls.join(again, _CALL, "left_semi").select("name"))
    names = durable(names.distinct(), "names")
    few = lambda df: df if df is None else df.join(names, "name", "left_semi")
    mine = lambda df: df if df is None else df.join(again, _CALL, "left_semi")
    rules = replace(after.rules, tiers=[replace(t, definitions=few(t.definitions), calls=mine(t.calls)) for t in after.rules.tiers])
    fresh = resolve(mine(after.calls), few(after.definitions), rules)
    gone = before.calls.join(changed, "file", "left_semi").select(*_CALL).union(again)
    return resolved.join(gone, _CALL, "left_anti").select(*fresh.columns).union(fresh)
