"""Differences of two graphs or diagrams, and incremental change sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, MODIFIED, UNCHANGED = "Added", "Removed", "Modified", "Unchanged"


def components(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """(id, status) by a full outer join on id; `fields` decide whether a component was modified."""
    b = before.select("id", F.struct(*fields).alias("b"))
    a = after.select("id", F.struct(*fields).alias("a"))
    status = F.when(F.col("b").isNull(), ADDED).when(F.col("a").isNull(), REMOVED).when(F.col("a").eqNullSafe(F.col("b")), UNCHANGED).otherwise(MODIFIED)
    return b.join(a, "id", "full_outer").select("id", status.alias("status"))


def connections(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from, to, status); a connection is never modified, and repeated ones stay."""
    keys = ["from", "to"]
    old, new = before.select(*keys), after.select(*keys)
    kept = new.join(old.distinct(), keys, "left_semi").withColumn("status", F.lit(UNCHANGED))
    added = new.join(old.distinct(), keys, "left_anti").withColumn("status", F.lit(ADDED))
    removed = old.join(new.distinct(), keys, "left_anti").withColumn("status", F.lit(REMOVED))
    return kept.unionByName(added).unionByName(removed)


def changes(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, change) of two (path, hash) tables: new, changed or deleted; unchanged paths are left out."""
    k, n = known.select("path", F.col("hash").alias("old")), listed.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return k.join(n, "path", "full_outer").withColumn("change", change).where("change IS NOT NULL").select("path", "change")


def stale(listed: DataFrame, cached_at: Column | None) -> DataFrame:
    """Paths modified after the cache was written, sorted; without a cache one marker row."""
    if cached_at is None:
        return listed.sparkSession.createDataFrame([("(no cache)",)], "path string")
    return listed.where(F.col("modificationTime") > cached_at).select("path").orderBy("path")


def absorb(master: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Union in which rows of `added` replace those with the same key."""
    return master.join(added.select(*key).distinct(), key, "left_anti").unionByName(added)


def forget(rows: DataFrame, gone: DataFrame, owner: str = "owner_path") -> DataFrame:
    """Rows whose owning path is not among `gone(path)`: an equality, so `a.rs` does not take `a.rs2` along."""
    return rows.join(gone.select(F.col("path").alias(owner)).distinct(), owner, "left_anti").select(*rows.columns)


def fnv1a(column: str = "content") -> Column:
    """FNV-1a of 64 bits of a binary or text column, as a signed long; bytes of all rows advance together."""

    @F.pandas_udf("bigint")
    def digest(values: pd.Series) -> pd.Series:
        raw = [v.encode() if isinstance(v, str) else bytes(v or b"") for v in values]
        sizes = np.array([len(r) for r in raw])
        out = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(raw[k] for k in order), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        state = out[order]
        for at in range(int(sizes.max()) if len(raw) else 0):
            live = int(np.searchsorted(-sizes[order], -at, "left"))
            state[:live] = (state[:live] ^ flat[starts[:live] + at].astype(np.uint64)) * np.uint64(0x100000001B3)
        out[order] = state
        return pd.Series(out.view(np.int64))

    return digest(F.col(column))


def with_hash(files: DataFrame) -> DataFrame:
    """(path, hash) of a (path, content) listing; hashing needs no shuffle."""
    return files.select("path", fnv1a("content").alias("hash"))
