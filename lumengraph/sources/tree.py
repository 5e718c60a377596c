"""A source tree as a Spark data source that leaves folders out while it lists.

`partitions` lists only the uppermost folders, until there are enough to share out; the tasks walk what is
below them. A folder that is left out is never entered, and no file is opened: rows carry path, size
and time of change, and `opened` reads the content of chosen files alone. Folders and files are
reached through Arrow's file systems (local, S3, GCS, HDFS), on the machines that run the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumengraph.runtime import prepare
from lumengraph.sources import board
from lumengraph.sources import files as S

FORMAT = "source_tree"
SHAPE = "path string, modificationTime timestamp, length bigint"
#: Folders to share out, rows of a batch, and bytes of content that are held at a time.
SHARES, ROWS, HELD = 64, 4096, 16 << 20


def connect(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)
    return fs.LocalFileSystem(), root


def left_out(folder: str) -> bool:
    """Whether a folder, given by its path below the root, is not entered."""
    above, _, name = folder.rpartition("/")
    dot = name.startswith(".") and name not in S.KEPT_DOT
    below = name == S.PRUNED_BELOW[1] and above.rpartition("/")[2] == S.PRUNED_BELOW[0]
    return dot or below or name.endswith("-out") or name.startswith("pythoncore-") or name in S.PRUNED


def listed(at: fs.FileSystem, base: str, folder: str) -> tuple[list[str], list[tuple]]:
    """Folders to enter and (path, time, size) of files in one folder; what is gone or closed to us has none."""
    try:
        found = at.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
    except OSError:
        return [], []
    folders, rows = [], []
    for x in sorted(found, key=lambda x: x.base_name):
        own = f"{folder}/{x.base_name}".lstrip("/")
        if x.type == fs.FileType.Directory and not left_out(own):
            folders.append(own)
        elif x.type == fs.FileType.File and not x.base_name.startswith("."):
            rows.append((own, (x.mtime_ns or 0) // 1000, x.size))
    return folders, rows


class Share(InputPartition):
    """Folders to walk, or, with `deep` false, to list alone."""

    def __init__(self, folders: list[str], deep: bool) -> None:
        self.folders, self.deep = folders, deep


class Reader(DataSourceReader):
    def __init__(self, root: str, shares: int) -> None:
        self.root, self.shares = root, shares

    def partitions(self) -> list[Share]:
        at, base = connect(self.root)
        shallow, deep = [], [""]
        # The widest level that is needed; each of its folders is then walked by one task.
        while deep and len(deep) < self.shares:
            shallow += deep
            deep = [below for folder in deep for below in listed(at, base, folder)[0]]
        cut = lambda folders, n: [folders[k::n] for k in range(min(n, len(folders)))]
        return [Share(x, False) for x in cut(shallow, 8)] + [Share(x, True) for x in cut(deep, 4 * self.shares)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        at, base = connect(self.root)
        waiting, rows = list(share.folders), []
        while waiting:
            below, found = listed(at, base, waiting.pop())
            rows += found
            waiting += below if share.deep else []
            if len(rows) >= ROWS or not waiting:
                yield _batch(rows)
                rows = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, times, sizes = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64())], names=["path", "modificationTime", "length"])


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options["path"], int(self.options.get("shares", SHARES)))


def listing(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """(path, modificationTime, length) below `root`, paths relative to it; of supported files, or of all that are not left out."""
    prepare(spark)
    spark.dataSource.register(Tree)
    rows = spark.read.format(FORMAT).load(root)
    return rows if everything else rows.where(S.supported(F.col("path")))


def opened(rows: DataFrame, root: str) -> DataFrame:
    """`rows` with the content of their `path` below `root`; a file that is gone or can't be read is left out."""
    at = rows.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = connect(root)
        for part in batches:
            kept, held, size = [], [], 0
            for k, path in enumerate(part.column(at).to_pylist()):
                try:
                    with where.open_input_stream(f"{base}/{path}", compression=None) as f:
                        data = f.read()
                except OSError:
                    continue
                kept.append(k)
                held.append(data)
                size += len(data)
                if size >= HELD:
                    yield made(part, kept, held)
                    kept, held, size = [], [], 0
            if kept:
                yield made(part, kept, held)

    def made(part: pa.RecordBatch, kept: list[int], held: list[bytes]) -> pa.RecordBatch:
        some = part.take(pa.array(kept))
        return pa.RecordBatch.from_arrays([*some.columns, pa.array(held, pa.binary())], names=[*some.schema.names, "content"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{shape}, content binary")


def boards(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the goal boards that a tree may have; `opened` leaves out those that it hasn't."""
    prepare(spark)
    return spark.createDataFrame([(f".harness/{name}",) for name in (board.NEW_FILE, board.LEGACY_FILE)], "path string")
