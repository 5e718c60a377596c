"""Snapshots of an indexed tree: a small manifest names all that belongs to one state.

Tables are written to folders of their own and never overwritten. A manifest, numbered, is written
last, under another name, and then renamed: a run that dies before leaves the former state as it
was, and two runs at once can't both take a number. Readers take the highest number. What neither
of the last two manifests names is swept, so that a query on the former state can end.

Rows of files are held in segments, one for each run that read files. `files` says which segment a
file's rows are in, so rows of changed and deleted files go without being rewritten; beyond
`SEGMENTS` they are merged into one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.sources.files import FORMAT_VERSION, StaleCacheError

SEGMENTS = 16
_MANIFESTS = "_snapshots"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@dataclass
class Snapshot:
    """One state: its number, its tables' folders by name, and the segments of rows."""

    number: int
    tables: dict[str, str] = field(default_factory=dict)
    segments: list[str] = field(default_factory=list)
    format: int = FORMAT_VERSION

    def folders(self) -> set[str]:
        return {*self.tables.values(), *self.segments}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        fs, path = _hadoop(self.spark, f"{self.root}/{_MANIFESTS}")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, number: int) -> Snapshot:
        text = self.spark.sparkContext.wholeTextFiles(f"{self.root}/{_MANIFESTS}/{number:010d}.json").first()[1]
        return Snapshot(**json.loads(text))

    def current(self) -> Snapshot:
        """The last state; none, or one of another format, is refused."""
        held = self.numbers()
        if not held:
            raise StaleCacheError(f"{self.root} holds no graph: index again")
        last = self.snapshot(held[-1])
        if last.format != FORMAT_VERSION:
            raise StaleCacheError(f"{self.root} has format {last.format}, not {FORMAT_VERSION}: index again")
        return last

    def table(self, name: str, last: Snapshot | None = None) -> DataFrame:
        last = last or self.current()
        return self.spark.read.parquet(f"{self.root}/{last.tables[name]}")

    def rows(self, last: Snapshot | None = None) -> DataFrame | None:
        """Rows of all live files; None where no segment has any."""
        last = last or self.current()
        if not last.segments:
            return None
        found = None
        for segment in last.segments:
            one = self.spark.read.parquet(f"{self.root}/{segment}").withColumn("segment", F.lit(segment))
            found = one if found is None else found.unionByName(one)
        live = self.table("files", last).select("path", "segment")
        return found.join(live, ["path", "segment"], "left_semi").drop("segment").select(*[c for c in found.columns if c != "segment"])

    def write(self, df: DataFrame, name: str) -> str:
        """A new folder with the rows of `df`; it belongs to no state until a manifest names it."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, tables: dict[str, str], segments: list[str]) -> Snapshot:
        """Makes the named folders the state of the store."""
        held = self.numbers()
        new = Snapshot((held[-1] if held else 0) + 1, tables, segments)
        fs, path = _hadoop(self.spark, f"{self.root}/{_MANIFESTS}/{new.number:010d}.json")
        _, draft = _hadoop(self.spark, f"{self.root}/{_MANIFESTS}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"another run has committed {path} meanwhile")
        self.sweep()
        return new

    def sweep(self) -> None:
        """Deletes manifests before the last two, and folders that those two don't name."""
        held = self.numbers()
        used = set().union(*(self.snapshot(n).folders() for n in held[-2:]), {_MANIFESTS})
        fs, root = _hadoop(self.spark, self.root)
        for number in held[:-2]:
            fs.delete(_hadoop(self.spark, f"{self.root}/{_MANIFESTS}/{number:010d}.json")[1], False)
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            if name not in used and name.split("-")[0] in ("files", "rows", "changes") and "-" in name:
                fs.delete(x.getPath(), True)
