"""Incremental indexing, continuous watch of a source tree, and files as keyed state of a stream."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumengraph.operators import delta, extract
from lumengraph.runtime import discard, durable, prepare, written
from lumengraph.sources import files as S
from lumengraph.sources import tree
from lumengraph.sources.store import SEGMENTS, Store

#: A file that changed so shortly before it was read may have changed again in the same tick: it is read once more.
TICK = "2 seconds"
_FILES = "path string, hash bigint, modificationTime timestamp, length bigint, segment string, seen timestamp"


def index(spark: SparkSession, root: str, store: str) -> int:
    """Brings the stored tables up to date with the tree; returns how many files were extracted anew.

    Only files whose size or time of change differs from what is stored are opened, and those that changed
    within `TICK` before they were last read; of those only the ones with another hash are extracted.
    Rows of other files stay where they are written. With nothing stored, or another format, everything
    is read. Nothing is written where nothing changed. Derived edges are computed from the stored
    rows and are never stored, so a run that only deletes is resolved anew like any other.
    """
    prepare(spark)
    before = written()
    held, began = Store(spark, store), time.time()
    try:
        last = held.current()
        known = held.table("files", last)
    except S.StaleCacheError:
        last, known = None, spark.createDataFrame([], _FILES)
    listed = durable(tree.listing(spark, root), "listed")
    old = known.select("path", F.col("hash").alias("old"), F.col("modificationTime").alias("then"), F.col("length").alias("size"), "seen")
    same = F.col("then").eqNullSafe(F.col("modificationTime")) & F.col("size").eqNullSafe(F.col("length")) & (F.col("modificationTime") < F.col("seen") - F.expr(f"INTERVAL {TICK}"))
    doubtful = listed.join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path", "modificationTime", "length")
    read = durable(tree.opened(doubtful, root).withColumn("hash", delta.fnv1a("content")), "read")
    unread = doubtful.join(read.select("path"), "path", "left_anti").select("path")  # gone since they were listed, or closed to us
    live = listed.join(unread, "path", "left_anti")
    now = live.join(read.select("path", "hash"), "path", "left").join(known.select("path", F.col("hash").alias("kept")), "path", "left").select("path", F.coalesce("hash", "kept").alias("hash"))
    changes = durable(delta.changes(known, now), "changes")
    fresh = changes.where("change <> 'deleted'").select("path")
    if changes.isEmpty() and last is not None:
        discard(spark, [p for p in written() if p not in before])
        return 0
    count = fresh.count()
    segments = list(last.segments) if last else []
    new = held.write(extract.tagged(S.decoded(read.join(fresh, "path", "left_semi"))), "rows") if count else None
    seen = F.timestamp_micros(F.lit(int(began * 1_000_000)))
    shape = ["path", "hash", "modificationTime", "length", "segment", "seen"]
    stays = known.join(changes.select("path"), "path", "left_anti").drop("modificationTime", "length")
    again = stays.join(read.select(F.col("path"), F.lit(True).alias("again")), "path", "left").withColumn("seen", F.when(F.col("again"), seen).otherwise(F.col("seen")))
    files = again.join(listed, "path").select(*shape).union(read.join(fresh, "path", "left_semi").select("path", "hash", "modificationTime", "length", F.lit(new).alias("segment"), seen.alias("seen")))
    folder = held.write(files, "files")
    log = held.write(changes.join(now, "path", "left").select("path", "change", "hash", seen.alias("at")), "changes")
    segments += [new] if new else []
    if len(segments) > SEGMENTS:
        segments, folder = _merged(held, segments, folder)
    held.commit({"files": folder, "changes": log}, segments)
    discard(spark, [p for p in written() if p not in before])
    return count


def _merged(held: Store, segments: list[str], folder: str) -> tuple[list[str], str]:
    """All segments as one, and the files with its name."""
    from lumengraph.sources.store import Snapshot

    one = held.write(held.rows(Snapshot(0, {"files": folder}, segments)), "rows")
    files = held.spark.read.parquet(f"{held.root}/{folder}").withColumn("segment", F.lit(one))
    return [one], held.write(files, "files")


def rows(spark: SparkSession, store: str) -> DataFrame:
    """Tagged rows of all live files."""
    found = Store(spark, store).rows()
    return spark.createDataFrame([], extract.ROW) if found is None else found


def watch(spark: SparkSession, root: str, store: str, seconds: int = 5) -> StreamingQuery:
    """Indexes every `seconds`; an error of one round is reported and the next round goes on.

    The file source reports neither deletions nor changes in place, so each round lists the tree and
    compares it with what is stored; a round without a change opens and writes nothing.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def round_(batch: DataFrame, number: int) -> None:
        try:
            index(spark, root, store)
        except Exception as e:  # noqa: BLE001  the watch goes on, as its contract says
            print(f"watch: round {number} failed: {e}")

    return ticks.writeStream.foreachBatch(round_).trigger(processingTime=f"{seconds} seconds").start()


class _File(StatefulProcessor):
    """State of a path: its last hash, or a tombstone that expires."""

    def __init__(self, expires: int) -> None:
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "hash bigint, at bigint")
        self.gone = handle.getValueState("gone", "hash bigint, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        held = self.held.get() if self.held.exists() else None
        gone = self.gone.get() if self.gone.exists() else None
        told = pd.concat(list(rows)).sort_values("at", kind="stable")
        for hash_, at in zip(told["hash"].tolist(), told["at"].tolist(), strict=True):
            at = int(pd.Timestamp(at).value // 1000)
            hash_ = None if pd.isna(hash_) else int(hash_)
            if at < max(x[1] for x in (held, gone, (0, at)) if x):
                continue  # later news are known already
            if hash_ is None:
                change = "deleted" if held else None
                held, gone = None, (held[0], at) if held else gone
            else:
                change = "returned" if gone and not held else "new" if not held else "changed" if held[0] != hash_ else None
                held, gone = (hash_, at), None
            if change:
                out.append((key[0], change, hash_, at))
        if gone:
            self.handle.registerTimer(gone[1] // 1000 + self.expires)
        for state, value in ((self.held, held), (self.gone, gone)):
            if value:
                state.update(value)
            elif state.exists():
                state.clear()
        if out:
            yield pd.DataFrame({"path": [x[0] for x in out], "change": [x[1] for x in out], "hash": [x[2] for x in out], "at": [x[3] for x in out]}, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.gone.exists() and self.gone.get()[1] // 1000 + self.expires <= expiredTimerInfo.getExpiryTimeInMs():
            self.gone.clear()
        yield from ()

    def close(self) -> None:
        pass


def file_changes(stream: DataFrame, expires: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(path, change, hash, at in microseconds) of a stream of (path, hash, at): what really changed.

    A null hash says that the path is gone. Of each path its last hash is state; a deleted one leaves a
    tombstone that tells a return (`returned`) from a first sight (`new`) until `expires` after the deletion,
    by the stream's own time. News that are older than what is known, or more than `late` behind the
    stream, and repeated ones, say nothing. The session's state store has to be the RocksDB provider.
    """
    shape = "path string, change string, hash bigint, at bigint"
    ms = int(pd.Timedelta(expires).total_seconds() * 1000)
    return stream.select("path", "hash", "at").withWatermark("at", late).groupBy("path").transformWithStateInPandas(_File(ms), shape, "append", "eventTime")


def last_hashes(stream: DataFrame) -> DataFrame:
    """(path, hash) of a stream of (path, hash, modificationTime): each path's last hash, held in micro-batch state."""
    return stream.groupBy("path").agg(F.max_by("hash", "modificationTime").alias("hash"))


def windows(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Beyond the reference: events counted per type in tumbling windows, late ones up to `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
