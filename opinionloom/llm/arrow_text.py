"""Arrow batches cut to a bounded number of text bytes, for the operators that work on whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most ``most`` bytes in a string column (a longer text goes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def in_python(
    source: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` whose tasks find this package where the driver has it, also without an installation."""
    environment, home = source.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if home not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, home])
    return source.mapInArrow(run, schema)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as bytes, nulls as empty ones."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
