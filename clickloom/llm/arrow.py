"""Steps over Arrow batches, several of which can share one pass through the Python workers."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

# Bytes and rows of a batch that a step holds at a time; a longer single row is held alone.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker's memory does not follow Spark's batches."""
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            rows = min(SLICE_ROWS, batch.num_rows - low)
            while rows > 1 and batch.slice(low, rows).nbytes > SLICE_BYTES:
                rows //= 2
            yield batch.slice(low, rows)
            low += rows


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns, which replace those of the same name."""
    kept = [name for name in batch.schema.names if name not in new]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *new.values()], names=[*kept, *new])


def mapped(
    docs: DataFrame,
    steps: Sequence[Step],
    added: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` after some steps in one pass: the columns to keep (all, if not named), then those
    that the steps add, which replace columns of the same name in any case."""
    new = {field.name.lower() for field in added}
    wanted = docs.columns if keep is None else keep
    kept = [field for field in docs.schema.fields if field.name in wanted and field.name.lower() not in new]
    schema = T.StructType([*kept, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = slices(batches)
        for step in steps:
            stream = step(stream)
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, or one made from it, that no column has in any case."""
    taken = {column.lower() for column in columns}
    while name in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, for clusters on which it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_clickloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="clickloom-")) / package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._clickloom_shipped = True
