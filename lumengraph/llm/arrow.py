"""Columns made from texts in Arrow batches; every other column passes through as it came."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of text that Python holds at a time; a longer text comes alone.
ROWS, BYTES = 1024, 4 << 20


def whole(docs: DataFrame) -> Column:
    """A row of `docs` as one struct, whatever its columns are called."""
    quoted = [c.replace("`", "``") for c in docs.columns]
    return F.struct(*[F.col(f"`{c}`") for c in quoted])


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = ROWS, size: int = BYTES, inner: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes in the column numbered `text`, or its field `inner`."""
    for batch in batches:
        texts = batch.column(text) if inner is None else batch.column(text).field(inner)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            held = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, held + size, "right"))))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def appended(docs: DataFrame, keep: list[str], added: str, start: Callable[[], Callable[[list], list]], text: str = "text", **held: int) -> DataFrame:
    """`keep` columns of `docs`, untouched, beside those that `start()` makes of each list of texts.

    added: names and types of the new columns, as in a schema string. `start` runs once per task.
    """
    new = StructType.fromDDL(added)
    schema = StructType([docs.schema[c] for c in keep] + new.fields)
    rows = docs.select(*keep, F.col(text).alias("\x1ftext"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work, kinds = start(), [to_arrow_type(f.dataType) for f in new.fields]
        for part in slices(batches, len(keep), **held):
            made = work(part.column(len(keep)).to_pylist())
            columns = [*part.columns[: len(keep)], *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _same_columns(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`docs` through `run`, which keeps its columns; they go by number, as names may hold dots."""
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def kept(docs: DataFrame, start: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """The rows of `docs`, untouched, for whose texts `start()` says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, at):
            yield part.filter(pa.array(work(part.column(at).to_pylist()), pa.bool_()))

    at = docs.columns.index(text)
    return _same_columns(docs, run)


def replaced(docs: DataFrame, start: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """`docs` with new texts from `start()`, all other columns untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, at):
            columns = part.columns
            columns[at] = pa.array(work(columns[at].to_pylist()), columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    at = docs.columns.index(text)
    return _same_columns(docs, run)
